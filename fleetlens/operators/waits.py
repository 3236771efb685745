"""Wait analysis: what the sessions of a server wait for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.columns import fleet_keys, int_div, ratio, wide_sum
from fleetlens.functions.wait_lists import EDITIONS
from fleetlens.plans.ordering import add_rank, reuse, top_n
from fleetlens.plans.sequences import counter_delta
from fleetlens.plans.totals import with_totals


def benign_waits(spark: SparkSession, edition: str = "server") -> DataFrame:
    """The wait types an edition leaves out of its reports."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in EDITIONS[edition]])).alias("wait_type"))


def _without(waits: DataFrame, benign: DataFrame | Sequence[str] | None) -> DataFrame:
    if benign is None:
        return waits
    if isinstance(benign, DataFrame):
        return waits.join(benign.select("wait_type"), "wait_type", "left_anti")
    return waits.where(~F.col("wait_type").isin(list(benign)))


def wait_pareto(waits: DataFrame, threshold: int = 99, benign: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """The largest wait types that together reach `threshold` percent of the wait time.

    A type is kept while the share of the larger types before it is below the
    threshold. Shares are compared as whole numbers, so no rounding decides.
    """
    keys = fleet_keys(waits)
    counted = reuse(_without(waits, benign).where(F.col("waiting_tasks_count") > 0).select(
        *keys, "wait_type", "wait_time_ms", "signal_wait_time_ms", "waiting_tasks_count",
        F.col("wait_time_ms").cast("decimal(28,0)").alias("_wide")))
    ranked = add_rank(counted, keys, ["-wait_time_ms", "wait_type"], "rank", {"_before": "_wide"})
    ranked = with_totals(ranked, keys, {"_all": wide_sum("wait_time_ms")}, counted)
    resource = F.col("wait_time_ms") - F.col("signal_wait_time_ms")
    return ranked.where(F.col("_before") * 100 < F.col("_all") * threshold).select(
        *keys, "wait_type", "rank",
        ratio("wait_time_ms", "_all", 2, 100).alias("wait_pct"),
        ratio("wait_time_ms", F.col("waiting_tasks_count") * 1000, 4).alias("avg_wait_s"),
        ratio(resource, F.col("waiting_tasks_count") * 1000, 4).alias("avg_resource_s"),
        ratio("signal_wait_time_ms", F.col("waiting_tasks_count") * 1000, 4).alias("avg_signal_s"),
        ratio("wait_time_ms", F.lit(1000), 2).alias("wait_s"),
        ratio(resource, F.lit(1000), 2).alias("resource_s"),
        ratio("signal_wait_time_ms", F.lit(1000), 2).alias("signal_s"),
        F.col("waiting_tasks_count").alias("wait_count"))


def wait_share_top(waits: DataFrame, n: int = 10, benign: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """The `n` largest wait types with their shares of all waits and of all signal waits."""
    keys = fleet_keys(waits)
    kept = _without(waits, benign).where(F.col("wait_time_ms") > 0)
    kept = with_totals(kept, keys, {"_wait": wide_sum("wait_time_ms"), "_signal": wide_sum("signal_wait_time_ms")})
    resource = F.col("wait_time_ms") - F.col("signal_wait_time_ms")
    return top_n(kept, keys, ["-wait_time_ms", "wait_type"], n).select(
        *keys, "wait_type", "wait_time_ms", "signal_wait_time_ms", resource.alias("resource_wait_time_ms"),
        ratio("wait_time_ms", "_wait", 4, 100).alias("pct_total_waits"),
        ratio("signal_wait_time_ms", "_signal", 4, 100).alias("pct_total_signal_waits"),
        ratio(resource, "_wait", 4, 100).alias("pct_total_resource_waits"))


def session_top_waits(session_waits: DataFrame, n: int = 5, min_ms: int = 500) -> DataFrame:
    """Per session the `n` largest waits above `min_ms`, as `type (x ms), ...`.

    `session_waits`: session_id, wait_type, wait_time_ms.
    """
    keys = [*fleet_keys(session_waits), "session_id"]
    summed = (session_waits.groupBy(*keys, "wait_type").agg(F.sum("wait_time_ms").alias("wait_time_ms"))
              .where(F.col("wait_time_ms") > min_ms))
    best = top_n(summed, keys, ["-wait_time_ms", "wait_type"], n)
    text = F.concat("wait_type", F.lit(" ("), F.col("wait_time_ms").cast("string"), F.lit(" ms)"))
    entries = F.array_sort(F.collect_list(F.struct((-F.col("wait_time_ms")).alias("o"), "wait_type", text.alias("t"))))
    return best.groupBy(*keys).agg(F.array_join(F.transform(entries, lambda x: x.t), ", ").alias("top_waits"))


def wait_info(waiting_tasks: DataFrame) -> DataFrame:
    """Per session and wait type the task count and times as one text:
    one task `(1x: a ms)`, two tasks `(2x: a/b ms)`, more `(nx: min/avg/max ms)`."""
    keys = [*fleet_keys(waiting_tasks), "session_id", "wait_type"]
    ms = F.col("wait_duration_ms")
    per = waiting_tasks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tasks"), F.min(ms).alias("lo"), F.max(ms).alias("hi"), F.sum(ms).alias("total"))

    def text(col: Column) -> Column:
        return col.cast("string")

    body = (F.when(F.col("tasks") == 1, text(F.col("lo")))
            .when(F.col("tasks") == 2, F.concat(text(F.col("lo")), F.lit("/"), text(F.col("hi"))))
            .otherwise(F.concat(text(F.col("lo")), F.lit("/"), text(int_div("total", "tasks")), F.lit("/"), text(F.col("hi")))))
    return per.select(*keys, F.concat(F.lit("("), text(F.col("tasks")), F.lit("x: "), body, F.lit("ms)"), F.col("wait_type")).alias("wait_info"))


def lock_waits(index_op_stats: DataFrame, objects: DataFrame, indexes: DataFrame) -> DataFrame:
    """Row and page lock waits per table, index and partition, where there are any."""
    keys = fleet_keys(index_op_stats, objects, indexes)
    group = [*keys, "object_id", "index_id", *[x for x in ("partition_number",) if x in index_op_stats.columns]]
    names = ("row_lock_wait_count", "row_lock_wait_in_ms", "page_lock_wait_count", "page_lock_wait_in_ms")
    sums = index_op_stats.groupBy(*group).agg(*[F.sum(x).alias(f"total_{x}") for x in names if x in index_op_stats.columns])
    sums = sums.withColumn("total_lock_wait_in_ms", F.col("total_row_lock_wait_in_ms") + F.col("total_page_lock_wait_in_ms"))
    return (sums.where(F.col("total_lock_wait_in_ms") > 0)
            .join(objects.select(*keys, "object_id", F.col("name").alias("table_name")), [*keys, "object_id"])
            .join(indexes.select(*keys, "object_id", "index_id", F.col("name").alias("index_name")), [*keys, "object_id", "index_id"]))


def wait_delta(waits_snapshots: DataFrame, order: Sequence[str] = ("collected_at",), bucket: Column | None = None) -> DataFrame:
    """Waits between two snapshots per wait type; NULL for the first snapshot and after a reset."""
    bucket = F.to_date("collected_at") if bucket is None else bucket
    keys = [*fleet_keys(waits_snapshots), "wait_type"]
    return counter_delta(waits_snapshots, keys, order, ["wait_time_ms"], bucket)
