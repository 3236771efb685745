"""Readers of landed views, error logs and event files, and the append sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.columns import as_time, fleet_keys
from fleetlens.sources.schemas import declared


def read_view(spark: SparkSession, root: str, view: str, instances: Sequence[str] | None = None, since: str | None = None, until: str | None = None, file_format: str = "parquet") -> DataFrame:
    """A landed view with its declared schema. Columns that older snapshots lack are NULL.

    `since` and `until` (dates) prune the day partitions; `instances` reaches the file scan as a filter.
    """
    df = spark.read.format(file_format).schema(declared(view)).load(f"{root}/{view}")
    if since is not None:
        df = df.where(F.col("collected_date") >= F.lit(since).cast("date"))
    if until is not None:
        df = df.where(F.col("collected_date") <= F.lit(until).cast("date"))
    return df if instances is None else df.where(F.col("instance_id").isin(list(instances)))


def conform(df: DataFrame, view: str) -> DataFrame:
    """Bring a frame to the declared columns of a view: missing ones become NULL, others are dropped."""
    schema = T.StructType.fromDDL(declared(view))
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def latest(view: DataFrame, as_of: Column | str) -> DataFrame:
    """The newest snapshot of every member that was collected at or before `as_of`."""
    keys = fleet_keys(view)
    past = view.where(F.col("collected_at") <= as_time(as_of))
    newest = past.groupBy(*keys).agg(F.max("collected_at").alias("collected_at"))
    if not keys:
        return past.where(F.col("collected_at") == newest.scalar())
    return past.join(newest, [*keys, "collected_at"], "left_semi")


def append_snapshots(df: DataFrame, root: str, view: str, file_format: str = "parquet") -> None:
    """Append snapshots to a landed view, partitioned by day. A day goes to as many
    tasks as its size asks for: adaptive execution splits and joins the parts."""
    rows = conform(df.withColumn("collected_date", F.to_date("collected_at")), view)
    rows.hint("rebalance", "collected_date").write.format(file_format).mode("append").partitionBy("collected_date").save(f"{root}/{view}")


_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d+)?)\s+(\S+)\s+(.*)$"


def read_errorlog(spark: SparkSession, path: str) -> DataFrame:
    """Error log files as rows of time, process and text. The number of the archive is
    the suffix of the file name (none for the current log)."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file"))
    part = [F.regexp_extract("value", _LINE, i) for i in (1, 2, 3)]
    known = F.rlike("value", F.lit(_LINE))
    number = F.regexp_extract("file", r"\.(\d+)$", 1)
    return lines.select(
        F.when(known, part[0]).try_cast("timestamp_ntz").alias("log_date"), F.when(known, part[1]).alias("process_info"), F.when(known, part[2]).otherwise(F.col("value")).alias("log_text"),
        F.when(number == "", F.lit("0")).otherwise(number).cast("int").alias("log_number"))


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of `<event>...</event>` documents as one row per event; the files stay splittable."""
    raw = spark.read.option("lineSep", "</event>").text(path)
    start = F.regexp_instr("value", F.lit(r"<event[\s>/]"))
    return raw.where(start > 0).select(F.concat(F.col("value").substr(start, F.length("value")), F.lit("</event>")).alias("event_xml"))
