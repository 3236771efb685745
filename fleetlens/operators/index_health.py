"""Index use, fragmentation, statistics, sizes and design findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_time, bracket, fleet_keys, int_div, ratio
from fleetlens.plans.ordering import top_n


def _reads() -> Column:
    return sum((F.coalesce(x, F.lit(0).cast("bigint")) for x in ("user_seeks", "user_scans", "user_lookups")), F.lit(0).cast("bigint"))


def _index(*frames: DataFrame) -> list[str]:
    return [*fleet_keys(*frames), "object_id", "index_id"]


def unused_indexes(indexes: DataFrame, usage: DataFrame, partitions: DataFrame, tables: DataFrame, as_of: Column | str,
                   min_rows: int = 200000, min_updates: int = 100, min_days: int = 30) -> DataFrame:
    """Indexes that are kept up to date but never read, on tables old and large
    enough, with the statements to disable or drop them. Partitions are summed
    before the join, so that partitioned tables are not counted twice."""
    index = _index(indexes, usage, partitions)
    table = [*fleet_keys(indexes, tables), "object_id"]
    sizes = partitions.groupBy(*index).agg(F.sum("row_count").alias("row_count"), (F.sum("reserved_page_count") * 8).alias("size_kb")).where(F.col("row_count") > min_rows)
    ix = indexes.where((F.col("index_id") > 1) & ~F.col("is_primary_key") & ~F.col("is_unique") & ~F.col("is_disabled"))
    old = tables.where(F.col("create_date") < as_time(as_of) - F.make_interval(days=F.lit(min_days)))
    used = usage.where((_reads() == 0) & (F.col("user_updates") > min_updates)).select(*index, "user_updates")
    out = (ix.join(used, index).join(sizes, index).join(old.select(*table, F.col("name").alias("table_name"), "create_date"), table))
    on = F.concat(bracket("name"), F.lit(" ON "), bracket("table_name"))
    return out.select(*index, "table_name", F.col("name").alias("index_name"), "row_count", "size_kb", "user_updates", "create_date",
                      F.concat(F.lit("ALTER INDEX "), on, F.lit(" DISABLE;")).alias("disable_command"), F.concat(F.lit("DROP INDEX "), on, F.lit(";")).alias("drop_command"))


def least_read_indexes(indexes: DataFrame, usage: DataFrame, n: int = 25) -> DataFrame:
    """The least read secondary indexes that are not constraints."""
    index = _index(indexes, usage)
    ix = indexes.where((F.col("type") == 2) & ~F.col("is_primary_key") & ~F.col("is_unique"))
    joined = ix.join(usage, index).select(*index, F.col("name").alias("index_name"), _reads().alias("total_reads"), "user_updates")
    return top_n(joined, fleet_keys(joined), ["total_reads", "-user_updates", "object_id", "index_id"], n)


def write_heavy_indexes(usage: DataFrame, indexes: DataFrame, partitions: DataFrame | None = None, some_reads: bool = False) -> DataFrame:
    """Secondary indexes written more often than read. `some_reads` keeps those that are read at all (unique ones included) and adds their size."""
    index = _index(usage, indexes)
    ix = indexes.where(F.col("index_id") > 1)
    if not some_reads:
        ix = ix.where((F.col("type") == 2) & ~F.col("is_primary_key") & ~F.col("is_unique"))
    out = usage.withColumn("total_reads", _reads()).where(F.col("user_updates") > F.col("total_reads"))
    if some_reads:
        out = out.where(F.col("total_reads") != 0)
    out = out.join(ix, index).select(*index, F.col("name").alias("index_name"), F.col("user_updates").alias("total_writes"), "total_reads", (F.col("user_updates") - F.col("total_reads")).alias("difference"))
    if partitions is not None:
        sizes = partitions.groupBy(*index).agg(ratio(F.sum("used_page_count"), F.lit(128), 2).alias("size_mb"))
        out = out.join(sizes, index)
    return out


def index_usage(indexes: DataFrame, usage: DataFrame, by: str = "reads") -> DataFrame:
    """Every index with its reads and writes, NULL where it was never used; sort by `reads` or `writes`."""
    index = _index(indexes, usage)
    counts = ("user_seeks", "user_scans", "user_lookups")
    joined = indexes.join(usage.select(*index, *counts, F.col("user_updates").alias("writes")), index, "left")
    total = F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups")
    return joined.select(*index, F.col("name").alias("index_name"), "type", *counts, total.alias("total_reads"), "writes",
                         F.col("writes" if by == "writes" else "user_seeks").isNull().alias("never_used"))


#: Verdict rules by fragmentation percent and page count.
POLICIES = ("listing", "fragmented", "rebuild_40", "reorganise_10_40", "reorganise_30")


def fragmentation(physical_stats: DataFrame, indexes: DataFrame, tables: DataFrame, policy: str = "listing", min_pct: int = 20, min_pages: int | None = None) -> DataFrame:
    """Fragmented indexes with a verdict.

    `listing`: more than 2,500 pages, no verdict. `fragmented`: above `min_pct`
    percent and 1,000 pages. `rebuild_40`: rebuild above 40 %. `reorganise_10_40`:
    nothing up to 1,000 pages or below 10 %, reorganise up to 40 %, else
    rebuild. `reorganise_30`: reorganise up to 30 %, else rebuild.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    index = _index(physical_stats, indexes)
    table = [*fleet_keys(physical_stats, tables), "object_id"]
    pct, pages = F.col("avg_fragmentation_in_percent"), F.col("page_count")
    rows = physical_stats
    if policy == "listing":
        rows = rows.where(pages > (2500 if min_pages is None else min_pages))
    elif policy in ("fragmented", "reorganise_30"):
        rows = rows.where((pct > min_pct) & (pages > (1000 if min_pages is None else min_pages)))
    out = rows.join(indexes.select(*index, F.col("name").alias("index_name")), index).join(tables.select(*table, F.col("name").alias("table_name")), table)
    verdict = {"listing": F.lit(None).cast("string"), "fragmented": F.lit(None).cast("string"), "rebuild_40": F.when(pct > 40, "REBUILD"),
               "reorganise_10_40": F.when((pages <= 1000) | (pct < 10), F.lit(None)).when(pct <= 40, "REORGANIZE").otherwise("REBUILD"),
               "reorganise_30": F.when(pct <= 30, "REORGANIZE").otherwise("REBUILD")}[policy]
    return out.select(*index, "table_name", "index_name", pct, pages, verdict.alias("action"),
                      F.concat(F.lit("ALTER INDEX "), bracket("index_name"), F.lit(" ON "), bracket("table_name"), F.lit(" "), verdict, F.lit(";")).alias("command"))


def index_metadata(indexes: DataFrame, objects: DataFrame, partitions: DataFrame, usage: DataFrame, fk_references: DataFrame, lists: DataFrame,
                   collected: Column | str, start_time: Column | str, restore_time: Column | str, local_zone: str) -> DataFrame:
    """One history row per index: use, locks, size, references, column lists, all
    times in UTC, and since when its counters can have been counting."""
    index = _index(indexes, partitions, usage, fk_references, lists)
    table = [*fleet_keys(indexes, objects), "object_id"]

    def utc(col: Column) -> Column:
        return F.convert_timezone(F.lit(local_zone), F.lit("UTC"), col)

    size = partitions.groupBy(*index).agg((F.sum("used_page_count") * 8).alias("size_kb"), F.sum("row_count").alias("row_count"))
    refs = fk_references.groupBy(*index).agg(F.count(F.lit(1)).alias("fk_reference_count"))
    times = [x for x in ("last_user_seek", "last_user_scan", "last_user_lookup") if x in usage.columns]
    out = (indexes.join(objects.select(*table, F.col("name").alias("object_name"), "create_date"), table)
           .join(usage, index, "left").join(size, index, "left").join(refs, index, "left").join(lists.select(*index, "key_list", "include_list"), index, "left"))
    zero = F.lit(0).cast("bigint")
    last = [utc(F.col(x)) for x in times]
    begin = F.greatest(as_time(start_time), as_time(restore_time), utc(F.col("create_date")))
    return out.select(
        *index, "object_name", F.coalesce("name", F.lit("<<HEAP>>")).alias("index_name"), begin.alias("stats_begin"),
        F.timestamp_diff("MILLISECOND", begin, as_time(collected)).alias("stats_age_ms"), (F.coalesce("fk_reference_count", zero) > 0).alias("has_fk_references"),
        F.coalesce("fk_reference_count", zero).alias("fk_reference_count"),
        *[F.coalesce(x, zero).alias(x) for x in ("user_seeks", "user_scans", "user_lookups", "user_updates")], _reads().alias("read_count"),
        (F.coalesce("row_lock_wait_in_ms", zero) + F.coalesce("page_lock_wait_in_ms", zero)).alias("total_lock_wait_ms"),
        (F.greatest(*last) if len(last) > 1 else last[0]).alias("last_read"), F.coalesce("size_kb", zero).alias("size_kb"), F.coalesce("row_count", zero).alias("row_count"), "key_list", "include_list")


def stale_statistics(stats_properties: DataFrame, partitions: DataFrame, as_of: Column | str, min_rows: int = 200000, min_mods: int = 100000, min_days: int = 35,
                     incremental: DataFrame | None = None) -> DataFrame:
    """Statistics long not updated in spite of many changes, with the update statement.
    Incremental statistics count with their oldest part."""
    keys = fleet_keys(stats_properties, partitions)
    rows = stats_properties if incremental is None else stats_properties.unionByName(incremental)
    old = rows.where((F.col("modification_counter") >= min_mods) & (F.col("last_updated") < as_time(as_of) - F.make_interval(days=F.lit(min_days))))
    large = (partitions.where(F.col("index_id") <= 1).groupBy(*keys, "object_id").agg(F.sum("row_count").alias("_rows")).where(F.col("_rows") >= min_rows))
    per = old.groupBy(*keys, "object_id", "stats_id").agg(F.min("last_updated").alias("last_update"), F.max("modification_counter").alias("modification_counter"))
    return per.join(large.select(*keys, "object_id"), [*keys, "object_id"], "left_semi").withColumn(
        "update_command", F.concat(F.lit("UPDATE STATISTICS "), bracket(F.col("object_id").cast("string")), F.lit(" "), bracket(F.col("stats_id").cast("string")), F.lit(";")))


def modified_statistics(stats_properties: DataFrame, as_of: Column | str, days: int = 1) -> DataFrame:
    """Statistics older than a day with changes since, and the changed share of the rows."""
    rows = stats_properties.where((F.col("modification_counter") > 0) & (F.col("last_updated") < as_time(as_of) - F.make_interval(days=F.lit(days))))
    return rows.withColumn("modified_pct", ratio("modification_counter", "row_count", 2, 100))


def labelled_statistics(stats: DataFrame) -> DataFrame:
    """Every statistic with its kind and filter in words."""
    auto, user = F.col("auto_created"), F.col("user_created")
    kind = F.when(~auto & ~user, "Index Statistic").when(~auto & user, "User Created").when(auto & ~user, "Auto Created").otherwise("Not Possible?")
    return stats.withColumns({"statistic_type": kind, "filtered": F.when(F.col("has_filter"), "Filtered Index").otherwise("No Filter")})


def volatile_statistics(stats_properties: DataFrame, objects: DataFrame) -> DataFrame:
    """Statistics with changes since their last update."""
    keys = [*fleet_keys(stats_properties, objects), "object_id"]
    return stats_properties.where(F.col("modification_counter") > 0).join(objects.select(*keys, F.col("name").alias("object_name")), keys)


# ---- sizes -------------------------------------------------------------------


def table_sizes(partition_stats: DataFrame, tables: DataFrame, layout: str = "rows", filegroups: DataFrame | None = None) -> DataFrame:
    """Table sizes.

    `rows`: rows and megabytes per table. `space`: total, used and unused space
    and bytes per row. `partition`: per index and partition with its filegroup
    (`filegroups`: object_id, index_id, filegroup_name). `kind`: data against index pages.
    """
    keys = [*fleet_keys(partition_stats, tables), "object_id"]
    named = tables.select(*keys, F.col("name").alias("table_name"))
    base = F.col("index_id") < 2
    if layout == "rows":
        per = partition_stats.where(base).groupBy(*keys).agg(F.sum("row_count").alias("row_count"), F.sum("reserved_page_count").alias("_pages"))
        return per.join(named, keys).select(*keys, "table_name", "row_count", ratio("_pages", F.lit(128), 2).alias("size_mb"))
    if layout == "space":
        per = partition_stats.groupBy(*keys).agg(F.sum(F.when(base, F.col("row_count")).otherwise(0)).alias("row_count"), F.sum("reserved_page_count").alias("_r"), F.sum("used_page_count").alias("_u"))
        unused = F.col("_r") - F.col("_u")
        return per.join(named, keys).select(
            *keys, "table_name", "row_count", (F.col("_r") * 8).alias("total_kb"), (F.col("_u") * 8).alias("used_kb"), (unused * 8).alias("unused_kb"),
            ratio("_r", F.lit(128), 2).alias("total_mb"), ratio("_r", F.lit(131072), 3).alias("total_gb"), int_div(F.col("_u") * 8192, "row_count").alias("bytes_per_row"))
    if layout == "partition":
        index = [*keys, "index_id"]
        out = partition_stats.join(named, keys)
        if filegroups is not None:
            out = out.join(filegroups.select(*index, "filegroup_name"), index, "left")
        return out.select(*index, "partition_number", "table_name", *(["filegroup_name"] if filegroups is not None else []),
                          ratio("used_page_count", F.lit(128), 2).alias("used_mb"), ratio("reserved_page_count", F.lit(128), 2).alias("reserved_mb"),
                          F.when(base, F.col("row_count")).otherwise(0).alias("row_count"), F.when(base, "data").otherwise("index").alias("kind"))
    if layout == "kind":
        per = partition_stats.groupBy(*keys, F.when(base, "data").otherwise("index").alias("kind")).agg(F.sum("used_page_count").alias("_u"))
        return per.join(named, keys).select(*keys, "table_name", "kind", ratio("_u", F.lit(128), 2).alias("used_mb"))
    raise ValueError(f"unknown layout {layout!r}")


def heap_tables(partition_stats: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables without a clustered index, with their rows."""
    keys = [*fleet_keys(partition_stats, tables), "object_id"]
    per = partition_stats.where(F.col("index_id") == 0).groupBy(*keys).agg(F.sum("row_count").alias("row_count"))
    return per.join(tables.select(*keys, F.col("name").alias("table_name")), keys)


_TYPES = {"sql_variant": "SQL_VARIANT data type", "text": "deprecated data type", "ntext": "deprecated data type", "image": "deprecated data type", "real": "floating-point data type", "float": "floating-point data type"}


def _type_findings(rows: DataFrame, what: str, keys: list[str]) -> DataFrame:
    plain = reduce(lambda acc, kv: F.when(F.col("type_name") == kv[0], F.lit(f"{what} with {kv[1]}")).otherwise(acc), _TYPES.items(),
                   F.when(F.col("type_name").isin("varchar", "nvarchar", "varbinary") & F.col("max_length").between(1, 2), f"Variable-length {what.lower()} with short max length"))
    return rows.select(*keys, "object_id", F.col("name").alias("detail"), plain.alias("finding")).where(F.col("finding").isNotNull())


def design_findings(columns: DataFrame, parameters: DataFrame, triggers: DataFrame, constraints: DataFrame, indexes: DataFrame, views: DataFrame) -> DataFrame:
    """Labelled design findings: padding off, doubtful data types of columns and
    parameters, triggers, disabled constraints and indexes, indexed views."""
    keys = fleet_keys(columns, parameters, triggers, constraints, indexes, views)

    def found(df: DataFrame, text: str) -> DataFrame:
        return df.select(*keys, "object_id", F.col("name").alias("detail"), F.lit(text).alias("finding"))

    padded = ("char", "nchar", "varchar", "nvarchar", "text", "ntext", "binary", "varbinary", "image")
    parts = [
        found(columns.where(~F.col("is_ansi_padded") & F.col("type_name").isin(*padded)), "trailing blanks of the column are not kept"),
        _type_findings(columns, "Column", keys), _type_findings(parameters, "Parameter", keys), found(triggers, "Trigger on user table"),
        found(constraints.where("is_disabled"), "Disabled constraint"), found(indexes.where("is_disabled"), "Disabled index"),
        found(views.join(indexes.select(*keys, "object_id"), [*keys, "object_id"], "left_semi"), "Indexed view"),
    ]
    return reduce(DataFrame.unionByName, parts)


def guid_leading_indexes(indexes: DataFrame, index_columns: DataFrame, columns: DataFrame, partition_stats: DataFrame, internal_tables: DataFrame, min_mb: int = 1024) -> DataFrame:
    """Indexes that begin with a GUID on tables above 1 GB; internal tables count towards their parent."""
    keys = fleet_keys(indexes, index_columns, columns, partition_stats, internal_tables)
    table = [*keys, "object_id"]
    own = partition_stats.where(F.col("index_id") <= 1).groupBy(*table).agg(F.sum("used_page_count").alias("pages"), F.sum("row_count").alias("row_count"))
    inner = internal_tables.join(partition_stats.groupBy(*table).agg(F.sum("used_page_count").alias("pages")), table).select(
        *keys, F.col("parent_object_id").alias("object_id"), "pages", F.lit(0).cast("bigint").alias("row_count"))
    sizes = own.unionByName(inner).groupBy(*table).agg(F.sum("pages").alias("pages"), F.sum("row_count").alias("row_count")).where(F.col("pages") > min_mb * 128)
    guid = columns.where(F.col("type_name") == "uniqueidentifier").select(*table, "column_id")
    leading = index_columns.where(F.col("key_ordinal") == 1).join(guid, [*table, "column_id"]).select(*table, "index_id").distinct()
    usable = indexes.where(F.col("type").isin(1, 2) & ~F.col("is_disabled"))
    return usable.join(leading, [*table, "index_id"], "left_semi").join(sizes, table).select(
        *table, "index_id", F.col("name").alias("index_name"), ratio("pages", F.lit(128), 2).alias("size_mb"), "row_count")


def columnstore_fragmentation(row_groups: DataFrame, indexes: DataFrame) -> DataFrame:
    """Deleted share of each row group, in whole percent."""
    index = _index(row_groups, indexes)
    return row_groups.join(indexes.select(*index, F.col("name").alias("index_name")), index).withColumn(
        "fragmentation", int_div(F.coalesce("deleted_rows", F.lit(0)) * 100, "total_rows"))


def memory_index_usage(indexes: DataFrame, scan_stats: DataFrame) -> DataFrame:
    """Scan counters of in-memory indexes."""
    index = _index(indexes, scan_stats)
    return indexes.select(*index, F.col("name").alias("index_name")).join(scan_stats, index)


def last_partitions_not_empty(partitions: DataFrame, layouts: DataFrame, ranges: DataFrame, gap: int = 2) -> DataFrame:
    """Partitions with rows close to the end of their partition function.

    `layouts`: object_id, function_id, fanout, boundary_on_right; `ranges`: function_id, boundary_id, value.
    """
    keys = fleet_keys(partitions, layouts, ranges)
    per = partitions.where((F.col("row_count") > 0) & (F.col("partition_number") > 1) & (F.col("index_id") <= 1)).join(layouts, [*keys, "object_id"])
    near = per.where(F.col("fanout") - F.col("partition_number") <= gap)
    near = near.withColumn("boundary_id", F.when(F.col("boundary_on_right"), F.col("partition_number") - 1).otherwise(F.col("partition_number")))
    out = near.join(ranges.select(*keys, "function_id", "boundary_id", F.col("value").alias("last_boundary")), [*keys, "function_id", "boundary_id"], "left")
    text = F.concat(F.lit("Table "), F.col("object_id").cast("string"), F.lit(' partition "'), F.col("partition_number").cast("string"), F.lit('" out of "'), F.col("fanout").cast("string"),
                    F.lit('" is not empty'), F.coalesce(F.concat(F.lit(' (boundary range "'), F.col("last_boundary").cast("string"), F.lit('")')), F.lit("")))
    return out.select(*keys, "object_id", "index_id", "partition_number", "fanout", "last_boundary", "row_count", text.alias("message"))


def table_properties(tables: DataFrame, partitions: DataFrame, properties: Sequence[str] = ()) -> DataFrame:
    """Table settings next to the rows and compression of the base index."""
    keys = [*fleet_keys(tables, partitions), "object_id"]
    per = partitions.where(F.col("index_id") < 2).groupBy(*keys).agg(F.sum("row_count").alias("row_count"), F.count(F.lit(1)).alias("partitions"))
    return tables.select(*keys, "name", *properties).join(per, keys)
