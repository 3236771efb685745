"""Ranks, running totals and leaderboards that do not sort one group in one task.

A rank or running total over a large group is computed in three steps:

1. cut points: the 1,000 rows of the group with the smallest hash of their
   sort key are a repeatable random sample; every 16th of them, in sort order,
   is a cut point. The sort key ends in a unique column, so equal values are
   split too.
2. each range between two cut points is counted and summed (map-side combine);
   the totals of the at most 64 ranges of a group give every range its offset.
3. a window inside each (group, range) adds the local rank and running sum.

Every step is a function of the rows alone, so a task that is run again after a
lost executor gives the same ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.columns import micros
from fleetlens.plans.joins import join_null_safe

SAMPLE = 1000
STEP = 16

#: A sort key is a list of column names; a leading "-" sorts a number or a
#: time downwards. The last name must make the key unique within its scope.
SortKey = Sequence[str]


def reuse(df: DataFrame) -> DataFrame:
    """Keep a reduced frame that several branches of one plan read.

    Blocks of a lost executor are computed again from their lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def order_columns(keys: SortKey) -> list[Column]:
    return [F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_first() for k in keys]


def _ascending(df: DataFrame, keys: SortKey) -> Column:
    kinds = dict(df.dtypes)
    parts = []
    for i, k in enumerate(keys):
        if not k.startswith("-"):
            parts.append(F.col(k).alias(f"k{i}"))
            continue
        name = k[1:]
        value = F.col(name)
        if kinds[name] == "timestamp":
            value = F.unix_micros(value)
        elif kinds[name] == "timestamp_ntz":
            value = micros(value)
        parts.append(F.isnull(name).alias(f"n{i}"))
        parts.append((-value).alias(f"k{i}"))
    return F.struct(*parts)


def with_ranges(df: DataFrame, scope: Sequence[str], keys: SortKey) -> DataFrame:
    """Add `_range`, the number of the cut-point interval the row falls into."""
    scope = list(scope)
    keyed = df.withColumn("_key", _ascending(df, keys))
    dice = F.xxhash64("_key")
    if scope:
        w = Window.partitionBy(*scope).orderBy(F.col("_dice"), F.col("_key"))
        sample = (keyed.select(*scope, "_key", dice.alias("_dice"))
                  .withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SAMPLE))
    else:
        sample = keyed.select("_key", dice.alias("_dice")).orderBy("_dice", "_key").limit(SAMPLE)
    cuts = F.filter(F.array_sort(F.collect_list("_key")), lambda _, i: i % STEP == STEP - 1).alias("_cuts")
    if scope:
        keyed = join_null_safe(keyed, sample.groupBy(*scope).agg(cuts), scope, "left")
    else:
        keyed = keyed.withColumn("_cuts", sample.agg(cuts).scalar())
    position = F.coalesce(F.size(F.filter("_cuts", lambda x: x < F.col("_key"))), F.lit(0))
    return keyed.withColumn("_range", position).drop("_cuts", "_key")


def add_rank(df: DataFrame, scope: Sequence[str], keys: SortKey, rank: str = "rank",
             running: dict[str, str] | None = None) -> DataFrame:
    """Row number by `keys` within `scope`, and for every `running` entry
    (new name -> column) the sum of that column over the rows before this one."""
    running = running or {}
    scope = list(scope)
    parts = reuse(with_ranges(reuse(df), scope, keys))
    per = parts.groupBy(*scope, "_range").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(src).alias(f"_s_{new}") for new, src in running.items()])
    # at most 64 range totals per scope: their prefix sums are array expressions
    parts_list = F.collect_list(F.struct("_range", "_rows", *[f"_s_{new}" for new in running])).alias("_parts")
    if scope:
        out = join_null_safe(parts, per.groupBy(*scope).agg(parts_list), scope)
    else:
        out = parts.withColumn("_parts", per.agg(parts_list).scalar())

    def before(name: str) -> Column:
        earlier = F.filter("_parts", lambda p: p["_range"] < F.col("_range"))
        kind = dict(per.dtypes)[name]
        return F.aggregate(earlier, F.lit(0).cast(kind), lambda acc, p: (acc + F.coalesce(p[name], F.lit(0).cast(kind))).cast(kind))

    local = Window.partitionBy(*scope, "_range").orderBy(*order_columns(keys))
    prior = local.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn(rank, (F.row_number().over(local) + before("_rows")).cast("bigint"))
    for new, src in running.items():
        out = out.withColumn(new, F.coalesce(F.sum(src).over(prior), F.lit(0)) + before(f"_s_{new}"))
    return out.select(*df.columns, rank, *running)


def top_n(df: DataFrame, scope: Sequence[str], keys: SortKey, n: int, rank: str | None = None) -> DataFrame:
    """The first `n` rows of every scope. Each task keeps only its own first `n`
    rows before anything is shuffled."""
    if not scope:
        out = df.orderBy(*order_columns(keys)).limit(n)
        if rank:
            out = out.withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order_columns(keys))).cast("bigint"))
        return out
    w = Window.partitionBy(*scope).orderBy(*order_columns(keys))
    out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n)
    return out.withColumn(rank, F.col("_rank").cast("bigint")).drop("_rank") if rank else out.drop("_rank")


#: How far around the cut the bracket reaches, as a share of the rows (three standard errors of a sample), and the sketch's accuracy.
BRACKET, ACCURACY = 0.05, 2000


def top_percent(df: DataFrame, scope: Sequence[str], keys: SortKey, percent: int) -> DataFrame:
    """The first `ceil(rows * percent / 100)` rows of every scope, by selection instead of a ranking of all.

    A sketch of the first sort key names a bracket around the cut, and one pass counts the rows before, in and behind
    it. Only the part that the cut falls into, by these counts, is ranked; what lies before it is taken whole. That is the
    bracket unless the sketch missed, and the result is exact in either case.

    The passes must agree on the bracket, but a sketch depends on the order in which tasks hand in their parts. So it is
    taken of the `SAMPLE` rows with the smallest hash of their sort key, which are the same ones in every pass.
    """
    kinds = dict(df.dtypes)
    name, down = keys[0].lstrip("-"), keys[0].startswith("-")
    if kinds[name] == "timestamp_ntz":
        value = micros(F.col(name)).cast("double")
    elif kinds[name] == "timestamp":
        value = F.unix_micros(name).cast("double")
    elif kinds[name] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[name].startswith("decimal"):
        value = F.col(name).cast("double")
    else:
        return _top_percent_ranked(df, scope, keys, percent)
    scope = list(scope)
    valued = df.withColumn("_v", value)
    at = 1 - percent / 100 if down else percent / 100
    ends = _bracket(valued, scope, keys, [max(at - BRACKET, 0.0), min(at + BRACKET, 1.0)])
    low, high = F.get("_ends", F.lit(0)), F.get("_ends", F.lit(1))
    # 0 before the bracket, 1 in it, 2 behind it; null sorts last downwards and first upwards
    inside = (F.col("_v") >= low) & (F.col("_v") <= high)
    if down:
        part = F.when(F.col("_v").isNull(), 2).when(inside, 1).when(F.col("_v") > high, 0).otherwise(2)
    else:
        part = F.when(F.col("_v").isNull(), 0).when(inside, 1).when(F.col("_v") < low, 0).otherwise(2)
    counts = [F.count(F.lit(1)).alias("_all"), F.count_if(F.col("_part") == 0).alias("_n0"), F.count_if(F.col("_part") == 1).alias("_n1")]
    if scope:
        parted = join_null_safe(valued, ends, scope, "left").withColumn("_part", part)
        counted = join_null_safe(parted, parted.groupBy(*scope).agg(*counts), scope)
    else:
        parted = valued.withColumn("_ends", ends.scalar()).withColumn("_part", part)
        counted = parted.withColumn("_c", parted.agg(F.struct(*counts).alias("_c")).scalar()).select("*", "_c.*").drop("_c")
    wanted = F.floor((F.col("_all") * percent + 99) / 100)
    cut = F.when(F.col("_n0") >= wanted, 0).when(F.col("_n0") + F.col("_n1") >= wanted, 1).otherwise(2)
    left = wanted - F.when(F.col("_cut") > 0, F.col("_n0")).otherwise(0) - F.when(F.col("_cut") > 1, F.col("_n1")).otherwise(0)
    placed = counted.withColumn("_cut", cut).withColumn("_left", left)
    whole = placed.where(F.col("_part") < F.col("_cut")).select(*df.columns)
    ranked = add_rank(placed.where(F.col("_part") == F.col("_cut")).select(*df.columns, "_left"), scope, keys, "_rank")
    return whole.unionByName(ranked.where(F.col("_rank") <= F.col("_left")).select(*df.columns))


def _bracket(valued: DataFrame, scope: list[str], keys: SortKey, ends: list[float]) -> DataFrame:
    """Per scope the values `_v` at two shares of the rows, from a sample that is a function of the rows alone."""
    sketch = F.percentile_approx("_v", F.array(*[F.lit(x) for x in ends]), F.lit(ACCURACY)).alias("_ends")
    diced = valued.withColumn("_key", _ascending(valued, keys)).withColumn("_dice", F.xxhash64("_key"))
    if not scope:
        return diced.orderBy("_dice", "_key").limit(SAMPLE).agg(sketch)
    w = Window.partitionBy(*scope).orderBy("_dice", "_key")
    return diced.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= SAMPLE).groupBy(*scope).agg(sketch)


def _top_percent_ranked(df: DataFrame, scope: Sequence[str], keys: SortKey, percent: int) -> DataFrame:
    """By a full ranking: for a first sort key that no sketch orders (a text)."""
    from fleetlens.plans.totals import with_totals

    ranked = add_rank(df, scope, keys, "_rank")
    counted = with_totals(ranked, scope, {"_all": F.count(F.lit(1))}, df)
    return counted.where(F.col("_rank") * 100 < F.col("_all") * percent + 100).drop("_rank", "_all")


def first_per(df: DataFrame, keys: Sequence[str], order: SortKey, columns: Sequence[str] | None = None) -> DataFrame:
    """The first row of every key by `order`, as an aggregate with map-side combine."""
    columns = [x for x in (columns or df.columns) if x not in keys]
    best = F.min_by(F.struct(*columns), _ascending(df, order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.`{x}`").alias(x) for x in columns])
