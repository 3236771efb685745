"""Index structure: what indexes contain, and which of them repeat each other.

Lists of columns are arrays of column ids; a descending key column is negative.
Pairs of indexes are found by equality: every index lists the prefixes of its
keys, and an index whose keys equal such a prefix is a candidate. No two
indexes of a table are compared unless their keys already agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import bracket, fleet_keys, starts_with
from fleetlens.plans.ordering import first_per, reuse

CLUSTERED, NONCLUSTERED = 1, 2
_INCLUDED, _LAST = 1 << 40, 1 << 30


def physical_index_columns(indexes: DataFrame, index_columns: DataFrame, columns: DataFrame) -> DataFrame:
    """The columns an index really stores, one row per index and column.

    A non-clustered index also holds the clustering key: at the end of its key
    when it is not unique, as included columns when it is. A clustered index
    includes all other columns of its table. Where a column appears twice, the
    key entry and then the defined entry wins.
    """
    keys = fleet_keys(indexes, index_columns, columns)
    table, index = [*keys, "object_id"], [*keys, "object_id", "index_id"]
    kind = indexes.select(*index, "type", F.col("is_unique").cast("int").alias("_unique"))
    defined = index_columns.join(kind, index).select(
        *index, "column_id", F.col("key_ordinal").cast("int").alias("key_ordinal"), F.col("is_descending_key").cast("int").alias("is_descending_key"),
        F.col("is_included_column").cast("int").alias("is_included_column"), F.lit(0).alias("is_secret_column"), "type")
    clustering = defined.where(F.col("type") == CLUSTERED).select(*table, "column_id", "key_ordinal", "is_descending_key")
    hidden = kind.where(F.col("type") == NONCLUSTERED).join(clustering, table).select(
        *index, "column_id", F.when(F.col("_unique") == 0, F.col("key_ordinal") + 1000000).otherwise(0).alias("key_ordinal"), "is_descending_key",
        F.col("_unique").alias("is_included_column"), F.lit(1).alias("is_secret_column"), "type")
    # every column of the table, behind all other entries: a column that the
    # clustered index defines is found under its own entry first
    rest = kind.where(F.col("type") == CLUSTERED).join(columns.select(*table, "column_id"), table).select(
        *index, "column_id", F.lit(_LAST).alias("key_ordinal"), F.lit(0).alias("is_descending_key"), F.lit(1).alias("is_included_column"), F.lit(0).alias("is_secret_column"), "type")
    # one exchange by index serves this aggregate, the lists and the joins by index
    every = defined.unionByName(hidden).unionByName(rest).repartition(*index)
    # the rank of an entry as one number: its minimum is a hash aggregate with
    # map-side combine, and all other columns can be read back from it
    rank = (F.col("is_included_column").cast("bigint") * _INCLUDED + F.col("key_ordinal").cast("bigint") * 4 + F.col("is_secret_column") * 2 + F.col("is_descending_key"))
    best = every.groupBy(*index, "column_id").agg(F.min(rank).alias("_r"))
    below = F.col("_r") % _INCLUDED
    ordinal = F.shiftright(below, 2)
    return best.select(
        *index, "column_id", F.when(ordinal == _LAST, 0).otherwise(ordinal).cast("int").alias("key_ordinal"), (F.col("_r") % 2).cast("int").alias("is_descending_key"),
        (F.col("_r") >= _INCLUDED).cast("int").alias("is_included_column"), (F.shiftright("_r", 1) % 2).cast("int").alias("is_secret_column"))


def index_column_lists(index_columns: DataFrame, indexes: DataFrame, include_order: str = "column_id") -> DataFrame:
    """Per index the ordered key list, the include list and the set of all columns.

    An index has at most a few hundred columns, so the lists are bounded.
    """
    index = [*fleet_keys(index_columns, indexes), "object_id", "index_id"]
    signed = F.when(F.col("is_descending_key").cast("int") == 1, -F.col("column_id")).otherwise(F.col("column_id"))
    is_key = F.col("is_included_column").cast("int") == 0

    # one list per index, in order of key and column; the others are cut out of it
    entry = F.struct(F.col("key_ordinal").cast("bigint").alias("o"), F.col("column_id").alias("c"), signed.alias("s"), is_key.alias("k"))
    per = index_columns.groupBy(*index).agg(F.array_sort(F.collect_list(entry)).alias("_all"))
    keys_of = F.transform(F.filter("_all", lambda x: x.k), lambda x: x.s)
    includes = F.transform(F.filter("_all", lambda x: ~x.k), lambda x: x.c)
    per = per.select(*index, keys_of.alias("key_columns"), (F.array_sort(includes) if include_order == "column_id" else includes).alias("include_columns"),
                     F.array_sort(F.array_distinct(F.transform("_all", lambda x: x.c))).alias("all_columns"))
    return per.join(indexes, index)


def as_text(columns: Column | str) -> Column:
    return F.array_join(F.transform(columns, lambda x: x.cast("string")), ",")


def normalise_filter(indexes: DataFrame) -> DataFrame:
    """Put the AND terms of each filter in alphabetical order, so that equal filters compare equal."""
    f = F.col("filter_definition")
    terms = F.array_sort(F.split(f.substr(F.lit(2), F.length(f) - 2), " AND "))
    return indexes.withColumn("filter_definition", F.when(f.isNotNull(), F.concat(F.lit("("), F.array_join(terms, " AND "), F.lit(")"))))


def _filter() -> Column:
    return F.coalesce("filter_definition", F.lit(""))


def duplicate_indexes(lists: DataFrame) -> DataFrame:
    """Non-clustered indexes of a table with equal filter, keys and includes."""
    table = [*fleet_keys(lists), "object_id"]
    rows = reuse(lists.where(F.col("type") == NONCLUSTERED).withColumn("_filter", _filter()))
    same = [*table, "_filter", "key_columns", "include_columns"]
    groups = rows.groupBy(*same).agg(F.min("index_id").alias("group_id"), F.count(F.lit(1)).alias("group_count")).where(F.col("group_count") > 1)
    return rows.join(groups, same).select(*table, "index_id", "group_id", "group_count", as_text("key_columns").alias("key_columns"), as_text("include_columns").alias("include_columns"))


def _candidates(lists: DataFrame, parents: Column, children: Column, use_filter: bool = True, unique_rule: bool = True) -> DataFrame:
    """Pairs (p, c) of a table where the keys of c are a prefix of the keys of p."""
    table = [*fleet_keys(lists), "object_id"]
    match = [*table, *(["_filter"] if use_filter else []), "_prefix"]
    # both sides of the pair read the lists: they are derived once
    rows = reuse(lists.withColumn("_filter", _filter()).select(*table, "index_id", "type", "is_unique", "_filter", "key_columns", "include_columns", "all_columns",
                                                               *[x for x in ("is_primary_key", "is_unique_constraint") if x in lists.columns]))
    every_prefix = F.transform(F.sequence(F.lit(1), F.size("key_columns")), lambda n: F.slice("key_columns", F.lit(1), n))
    # a unique index only takes in indexes with equal keys
    prefixes = F.when(F.col("is_unique"), F.array("key_columns")).otherwise(every_prefix) if unique_rule else every_prefix

    # a filter that is equal on both sides and the keys of a child, which are the prefix, travel once
    carried = [x for x in rows.columns if x not in (*table, "_filter")]

    def side(df: DataFrame, name: str, cols: list[str]) -> DataFrame:
        return df.select(*match, F.struct(*cols).alias(name))

    big = side(rows.where(parents & (F.size("key_columns") > 0)).withColumn("_prefix", F.explode(prefixes)), "p", carried)
    small = side(rows.where(children & (F.size("key_columns") > 0)).withColumn("_prefix", F.col("key_columns")), "c", [x for x in carried if x != "key_columns"])
    pairs = big.join(small, match).withColumn("c", F.col("c").withField("key_columns", F.col("_prefix"))).where(F.col("p.index_id") != F.col("c.index_id"))
    if unique_rule:
        pairs = pairs.where(F.col("p.is_unique") | ~F.col("c.is_unique"))
    return pairs


def _not_constraint(lists: DataFrame) -> Column:
    test = F.col("type") != CLUSTERED
    for flag in ("is_primary_key", "is_unique_constraint"):
        if flag in lists.columns:
            test &= ~F.col(flag)
    return test


def _shapes(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The different indexes of each table, each once under a digest of its shape,
    and the shape of every index.

    Copies of one index then meet other indexes once, not once per copy.
    """
    flags = [x for x in ("is_primary_key", "is_unique_constraint") if x in lists.columns]
    shape = [*fleet_keys(lists), "object_id", "filter_definition", "type", "is_unique", *flags, "key_columns", "include_columns", "all_columns"]
    parts = [F.col(x).cast("string") for x in ("type", "is_unique", *flags)] + [as_text(x) for x in ("key_columns", "include_columns", "all_columns")] + [_filter()]
    # half of a SHA-256 as bytes: every prefix of a shape travels with it, and digits of a digest do not compress
    digest = F.unhex(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32))
    rows = reuse(lists.select("index_id", *shape, digest.alias("_shape")))
    shapes = rows.select(*shape, F.col("_shape").alias("index_id")).distinct()
    return shapes, rows.select(*fleet_keys(lists), "object_id", "_shape", "index_id")


def _with_copies(pairs: DataFrame, members: DataFrame, first: str, second: str) -> DataFrame:
    """Replace the shapes of matched pairs by the indexes that have them."""
    table = [*fleet_keys(pairs), "object_id"]
    out = pairs
    for name in (first, second):
        ids = members.select(*table, F.col("_shape").alias(name), F.col("index_id").alias(f"_{name}"))
        out = out.join(ids, [*table, name]).withColumn(name, F.col(f"_{name}")).drop(f"_{name}")
    return out


def covered_indexes(lists: DataFrame, max_diff: int = 5) -> DataFrame:
    """Indexes that another index of the table makes superfluous, with the columns it has beyond them."""
    table = [*fleet_keys(lists), "object_id"]
    shapes, members = _shapes(lists)
    pairs = _candidates(shapes, F.lit(True), _not_constraint(lists))
    inside = F.size(F.array_except("c.all_columns", "p.all_columns")) == 0
    differs = (F.col("p.key_columns") != F.col("c.key_columns")) | (F.col("p.all_columns") != F.col("c.all_columns"))
    pairs = reuse(pairs.where((F.col("p.type") == CLUSTERED) | (inside & differs)))
    # a parent that is covered itself is left out
    tops = pairs.select(*table, F.col("c.index_id").alias("_parent")).distinct()
    stored = F.concat(F.transform("p.key_columns", lambda x: F.abs(x)), F.col("p.include_columns"))
    extra = F.filter(stored, lambda x: ~F.array_contains(F.col("c.all_columns"), x))
    diff = F.size("p.all_columns") - F.size("c.all_columns")
    found = pairs.withColumn("_parent", F.col("p.index_id")).join(tops, [*table, "_parent"], "left_anti").where(diff <= max_diff).select(
        *table, F.col("p.index_id").alias("index_id"), F.col("c.index_id").alias("covered_index_id"), as_text("p.key_columns").alias("key_columns"),
        as_text("c.key_columns").alias("covered_key_columns"), diff.alias("column_difference"), as_text(extra).alias("extra_columns"))
    return _with_copies(found, members, "index_id", "covered_index_id")


def mergeable_indexes(lists: DataFrame, max_extra: int = 3) -> DataFrame:
    """Pairs that one index could serve if it took in one to three more columns; one direction per pair."""
    table = [*fleet_keys(lists), "object_id"]
    eligible = _not_constraint(lists) & (F.col("type") == NONCLUSTERED)
    shapes, members = _shapes(lists)
    pairs = _candidates(shapes, eligible, eligible)
    extra = F.size(F.array_except("c.all_columns", "p.all_columns"))
    same_keys = F.col("p.key_columns") == F.col("c.key_columns")
    pairs = pairs.where(extra.between(1, max_extra) & (~same_keys | (F.size("p.include_columns") > 0))).select(
        *table, F.col("p.index_id").alias("index_id"), F.col("c.index_id").alias("merged_index_id"), extra.alias("extra_column_count"))
    pairs = _with_copies(pairs, members, "index_id", "merged_index_id")
    pairs = pairs.withColumns({"_a": F.least("index_id", "merged_index_id"), "_b": F.greatest("index_id", "merged_index_id")})
    return first_per(pairs, [*table, "_a", "_b"], ["extra_column_count", "index_id"]).drop("_a", "_b")


def redundant_indexes(lists: DataFrame, usage: DataFrame, partitions: DataFrame, min_rows: int = 200000) -> DataFrame:
    """Indexes whose defined keys and includes are both prefixes of another index's,
    on tables with enough rows, with the use of both and the statement to drop them."""
    keys = fleet_keys(lists, usage, partitions)
    index = [*keys, "object_id", "index_id"]
    rows = partitions.groupBy(*index).agg(F.sum("row_count").alias("_rows")).where(F.col("_rows") >= min_rows)
    large = lists.join(rows.select(*index), index, "left_semi")
    pairs = _candidates(large, F.lit(True), (F.col("index_id") != 1) & ~F.col("is_unique"), unique_rule=False)
    pairs = pairs.where((F.size("c.include_columns") == 0) | starts_with("p.include_columns", "c.include_columns"))
    out = pairs.select(*keys, "object_id", F.col("c.index_id").alias("index_id"), F.col("p.index_id").alias("containing_index_id"),
                       as_text("c.key_columns").alias("key_columns"), as_text("c.include_columns").alias("include_columns"))
    used = usage.select(*index, "user_seeks", "user_scans", "user_updates")
    both = used.select(*keys, "object_id", F.col("index_id").alias("containing_index_id"), *[F.col(x).alias(f"containing_{x}") for x in ("user_seeks", "user_scans", "user_updates")])
    return (out.join(used, index, "left").join(both, [*keys, "object_id", "containing_index_id"], "left")
            .withColumn("drop_command", F.concat(F.lit("DROP INDEX "), F.col("index_id").cast("string"), F.lit(" ON "), F.col("object_id").cast("string"), F.lit(";"))))


def redundant_indexes_long_short(lists: DataFrame) -> DataFrame:
    """Pairs of a long and a short index: keys and includes of the short one are equal
    to, or prefixes of, those of the long one; equal pairs are listed once. Direction and filter do not count."""
    table = [*fleet_keys(lists), "object_id"]
    plain = lists.withColumn("key_columns", F.transform("key_columns", lambda x: F.abs(x)))
    pairs = _candidates(plain, F.lit(True), F.lit(True), use_filter=False, unique_rule=False)
    longer = (F.size("p.key_columns") > F.size("c.key_columns")) | (F.size("p.include_columns") > F.size("c.include_columns"))
    pairs = pairs.where(starts_with("p.include_columns", "c.include_columns") & (longer | (F.col("p.index_id") < F.col("c.index_id"))))
    return pairs.select(*table, F.col("p.index_id").alias("long_index_id"), F.col("c.index_id").alias("short_index_id"),
                        as_text("p.key_columns").alias("long_keys"), as_text("p.include_columns").alias("long_includes"),
                        as_text("c.key_columns").alias("short_keys"), as_text("c.include_columns").alias("short_includes"))


def foreign_keys_without_index(foreign_keys: DataFrame, fk_columns: DataFrame, lists: DataFrame, table_names: DataFrame) -> DataFrame:
    """Foreign keys no index supports: their column list is neither a prefix of an
    index key list of the table, nor has one as prefix. With the index to create."""
    keys = fleet_keys(foreign_keys, fk_columns, lists)
    fk = [*keys, "constraint_object_id"]
    # `fk_columns`: constraint_object_id, constraint_column_id, parent_column_id, column_name
    listed = F.array_sort(F.collect_list(F.struct("constraint_column_id", "parent_column_id", "column_name")))
    cols = fk_columns.groupBy(*fk).agg(listed.alias("_c")).select(
        *fk, F.transform("_c", lambda x: x.parent_column_id).alias("_columns"), F.transform("_c", lambda x: x.column_name).alias("_names"))
    keyed = foreign_keys.join(cols, fk).withColumnRenamed("parent_object_id", "object_id")
    index_keys = lists.select(*keys, "object_id", F.transform("key_columns", lambda x: F.abs(x)).alias("_columns")).where(F.size("_columns") > 0).distinct()
    table = [*keys, "object_id"]

    def prefixes(df: DataFrame) -> DataFrame:
        every = F.transform(F.sequence(F.lit(1), F.size("_columns")), lambda n: F.slice("_columns", F.lit(1), n))
        return df.withColumn("_columns", F.explode(every))

    missing = keyed.join(prefixes(index_keys).distinct(), [*table, "_columns"], "left_anti")
    served = prefixes(missing.select(*fk, "object_id", "_columns")).join(index_keys, [*table, "_columns"], "left_semi").select(*fk).distinct()
    missing = missing.join(served, fk, "left_anti").join(table_names.select(*table, F.col("name").alias("table_name")), table, "left")
    columns = F.array_join(F.transform("_names", lambda x: bracket(x)), ", ")
    index_name = F.concat(F.lit("IX_"), F.array_join("_names", "_"))
    return missing.select(*table, "constraint_object_id", F.col("name").alias("foreign_key_name"), "table_name", columns.alias("foreign_key_columns"),
                          F.concat(F.lit("CREATE NONCLUSTERED INDEX "), bracket(index_name), F.lit(" ON "), bracket("table_name"), F.lit(" ("), columns, F.lit(");")).alias("create_index"))


def column_list_text(index_columns: DataFrame, columns: DataFrame) -> DataFrame:
    """Key and include lists of each index by name, e.g. `[a], [b] DESC`."""
    keys = fleet_keys(index_columns, columns)
    index = [*keys, "object_id", "index_id"]
    named = index_columns.join(columns.select(*keys, "object_id", "column_id", F.col("name").alias("_name")), [*keys, "object_id", "column_id"])
    is_key = F.col("is_included_column").cast("int") == 0
    text = F.concat(bracket("_name"), F.when(F.col("is_descending_key").cast("int") == 1, " DESC").otherwise(""))

    def listed(where: Column, value: Column) -> Column:
        entries = F.array_sort(F.collect_list(F.when(where, F.struct("key_ordinal", "column_id", value.alias("v")))))
        return F.nullif(F.array_join(F.transform(entries, lambda x: x.v), ", "), F.lit(""))

    return named.groupBy(*index).agg(listed(is_key, text).alias("key_list"), listed(~is_key, bracket("_name")).alias("include_list"))


def shared_columns(lists: DataFrame, names: Sequence[str] = ("key_columns", "include_columns", "all_columns")) -> DataFrame:
    """The lists as text with their sizes, for reports."""
    out = lists
    for n in names:
        out = out.withColumn(f"{n}_count", F.size(n)).withColumn(n, as_text(n))
    return out
