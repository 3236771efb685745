"""File and drive input/output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import c, fleet_keys, int_div, int_div0, long_sum, ratio, wide_sum
from fleetlens.plans.ordering import add_rank, reuse
from fleetlens.plans.sequences import counter_delta
from fleetlens.plans.totals import with_totals


def _with_files(file_stats: DataFrame, files: DataFrame) -> tuple[DataFrame, list[str]]:
    keys = [*fleet_keys(file_stats, files), "database_id", "file_id"]
    return file_stats.join(files, keys), keys


def _reads_writes(a: str, b: str) -> Column:
    return F.col(a) + F.col(b)


def file_latency(file_stats: DataFrame, files: DataFrame) -> DataFrame:
    """Average stall per read, write and transfer of each file, with one added to
    the counts so that idle files give 0."""
    joined, keys = _with_files(file_stats, files)
    stalls, total = _reads_writes("io_stall_read_ms", "io_stall_write_ms"), _reads_writes("num_of_reads", "num_of_writes")
    return joined.select(
        *keys, "physical_name", "type", ratio("size", F.lit(128), 2).alias("size_mb"),
        ratio("io_stall_read_ms", F.col("num_of_reads") + 1, 1).alias("avg_read_latency_ms"),
        ratio("io_stall_write_ms", F.col("num_of_writes") + 1, 1).alias("avg_write_latency_ms"),
        ratio(stalls, total + 1, 1).alias("avg_io_latency_ms"),
        "io_stall_read_ms", "num_of_reads", "io_stall_write_ms", "num_of_writes",
        stalls.alias("io_stalls"), total.alias("total_io"))


_SUMS = ("num_of_reads", "num_of_writes", "io_stall_read_ms", "io_stall_write_ms", "num_of_bytes_read", "num_of_bytes_written")


def drive_latency(file_stats: DataFrame, files: DataFrame) -> DataFrame:
    """Latency and transfer sizes per drive in whole numbers, 0 where nothing was transferred."""
    joined, keys = _with_files(file_stats, files)
    mount = [x for x in ("volume_mount_point",) if x in files.columns]
    group = [*keys[:-2], "drive", *mount]
    per = joined.withColumn("drive", F.upper(F.left("physical_name", F.lit(2)))).groupBy(*group).agg(*[F.sum(x).alias(x) for x in _SUMS])
    count = _reads_writes("num_of_reads", "num_of_writes")
    return per.select(
        *group,
        int_div0("io_stall_read_ms", "num_of_reads").alias("read_latency"),
        int_div0("io_stall_write_ms", "num_of_writes").alias("write_latency"),
        int_div0(_reads_writes("io_stall_read_ms", "io_stall_write_ms"), count).alias("overall_latency"),
        int_div0("num_of_bytes_read", "num_of_reads").alias("avg_bytes_read"),
        int_div0("num_of_bytes_written", "num_of_writes").alias("avg_bytes_write"),
        int_div0(_reads_writes("num_of_bytes_read", "num_of_bytes_written"), count).alias("avg_bytes_transfer"))


def drive_latency_smoothed(file_stats: DataFrame, files: DataFrame) -> DataFrame:
    """Latency per drive letter with one added to the counts."""
    joined, keys = _with_files(file_stats, files)
    group = [*keys[:-2], "drive"]
    per = joined.withColumn("drive", F.left("physical_name", F.lit(1))).groupBy(*group).agg(*[F.sum(x).alias(x) for x in _SUMS])
    return per.select(
        *group,
        ratio("io_stall_read_ms", F.col("num_of_reads") + 1, 1).alias("avg_read_disk_latency_ms"),
        ratio("io_stall_write_ms", F.col("num_of_writes") + 1, 1).alias("avg_write_disk_latency_ms"),
        ratio(_reads_writes("io_stall_read_ms", "io_stall_write_ms"), _reads_writes("num_of_reads", "num_of_writes") + 1, 1).alias("avg_disk_latency_ms"))


def io_share_by_database(file_stats: DataFrame) -> DataFrame:
    """Transferred megabytes per database, rank by total and shares of the whole."""
    keys = fleet_keys(file_stats)
    per = file_stats.groupBy(*keys, "database_id").agg(
        int_div(F.sum(_reads_writes("num_of_bytes_read", "num_of_bytes_written")), F.lit(1048576)).alias("total_mb"),
        int_div(F.sum("num_of_bytes_read"), F.lit(1048576)).alias("read_mb"),
        int_div(F.sum("num_of_bytes_written"), F.lit(1048576)).alias("write_mb"))
    per = reuse(per)
    ranked = add_rank(per, keys, ["-total_mb", "database_id"], "io_rank")
    names = ("total", "read", "write")
    ranked = with_totals(ranked, keys, {f"_{x}": wide_sum(f"{x}_mb") for x in names}, per)
    return ranked.select(*keys, "io_rank", "database_id", *[f"{x}_mb" for x in names],
                         *[ratio(f"{x}_mb", f"_{x}", 2, 100).alias(f"{x}_pct") for x in names])


def io_mix_by_file(file_stats: DataFrame, files: DataFrame) -> DataFrame:
    """Reads against writes of each file: shares of stall time, count and bytes; NULL where there were none."""
    joined, keys = _with_files(file_stats, files)
    pairs = {"io_stall": ("io_stall_read_ms", "io_stall_write_ms"), "count": ("num_of_reads", "num_of_writes"),
             "bytes": ("num_of_bytes_read", "num_of_bytes_written")}
    out = [_reads_writes("num_of_reads", "num_of_writes").alias("reads_and_writes"),
           ratio("num_of_bytes_read", F.lit(1048576), 2).alias("mb_read"), ratio("num_of_bytes_written", F.lit(1048576), 2).alias("mb_written")]
    for name, (r, w) in pairs.items():
        out += [ratio(r, _reads_writes(r, w), 1, 100).alias(f"{name}_reads_pct"), ratio(w, _reads_writes(r, w), 1, 100).alias(f"{name}_writes_pct")]
    return joined.select(*keys, "physical_name", *out)


def io_threshold_check(file_stats: DataFrame, files: DataFrame) -> DataFrame:
    """Average stall against the recommended maximum of the file kind: data files
    30 ms, log files 5 ms to read and 2 ms to write. Only files with both reads and writes."""
    joined, keys = _with_files(file_stats.where((F.col("num_of_reads") > 0) & (F.col("num_of_writes") > 0)), files)
    is_log, is_data = F.col("type") == 1, F.col("type") == 0
    temp = F.col("name") == "tempdb" if "name" in files.columns else F.lit(False)

    def limit(log: int) -> Column:
        return F.when(is_data, 30).when(is_log, log).otherwise(0)

    return joined.select(
        *keys, "physical_name", "type", F.upper(F.substring("physical_name", 1, 2)).alias("drive"),
        int_div("io_stall_read_ms", "num_of_reads").alias("avg_read_stall_ms"), limit(5).alias("max_read_stall_ms"),
        int_div("io_stall_write_ms", "num_of_writes").alias("avg_write_stall_ms"), limit(2).alias("max_write_stall_ms"),
        ratio("num_of_bytes_read", F.lit(1073741824), 1).alias("gb_read"), ratio("num_of_bytes_written", F.lit(1073741824), 1).alias("gb_written"),
        F.when(temp | is_log, "N/A").otherwise("PAGEIOLATCH*").alias("read_wait"),
        F.when(is_log, "WRITELOG").when(temp, "xxx").when(is_data, "ASYNC_IO_COMPLETION").otherwise("xxx").alias("write_wait"))


def io_counts_by_database(file_stats: DataFrame, databases: DataFrame) -> DataFrame:
    """Reads and writes summed per database."""
    keys = [*fleet_keys(file_stats, databases), "database_id"]
    per = file_stats.groupBy(*keys).agg(long_sum("num_of_reads").alias("reads"), long_sum("num_of_writes").alias("writes"))
    return per.join(databases.select(*keys, "name"), keys)


def io_raw_latency(file_stats: DataFrame) -> DataFrame:
    """Stall per read and write without smoothing, NULL for idle files, with flags
    for the guidance of 20 ms (transactions), 30 ms (warehouse) and 5 ms (log)."""
    read = int_div("io_stall_read_ms", "num_of_reads")
    write = int_div("io_stall_write_ms", "num_of_writes")
    keys = [*fleet_keys(file_stats), "database_id", "file_id"]
    return file_stats.select(
        *keys, "num_of_reads", "num_of_writes", read.alias("avg_read_latency_ms"), write.alias("avg_write_latency_ms"),
        (F.coalesce(read, F.lit(0)) > 20).alias("above_oltp"), (F.coalesce(read, F.lit(0)) > 30).alias("above_dw"),
        (F.coalesce(write, F.lit(0)) > 5).alias("above_log"))


def io_window(snapshots: DataFrame, keys: Sequence[str], value: str, measured_gb: int, target_gb: int,
              order: Sequence[str] = ("collected_at",), bucket: Column | None = None) -> DataFrame:
    """Megabytes transferred between two samples, and scaled from the measured to the target size."""
    bucket = F.to_date("collected_at") if bucket is None else bucket
    out = counter_delta(snapshots, [*fleet_keys(snapshots), *keys], order, [value], bucket)
    grown = F.col(f"{value}_delta")
    return out.select(*snapshots.columns, grown.alias("bytes_delta"), ratio(grown, F.lit(1048576), 4).alias("mb"),
                      ratio(grown * F.lit(target_gb), F.lit(1048576 * measured_gb), 4).alias("estimated_mb"))


def io_warning_lines(errorlog: DataFrame, pattern: str = "taking longer than 15 seconds", n_logs: int = 6) -> DataFrame:
    """Lines about slow requests in the newest logs."""
    out = errorlog.where(F.contains("log_text", F.lit(pattern)))
    return out.where(F.col("log_number") < n_logs) if "log_number" in errorlog.columns else out


def tempdb_file_stall(file_stats: DataFrame, files: DataFrame, database_id: int = 2) -> DataFrame:
    """Queued stall per read and write for the row files of the temporary database."""
    joined, keys = _with_files(file_stats.where(F.col("database_id") == database_id), files.where(F.col("type") == 0))

    def stall(kind: str) -> Column:
        queued = f"io_stall_queued_{kind}_ms"
        return c(queued if queued in joined.columns else f"io_stall_{kind}_ms")

    return joined.select(*keys, "physical_name", ratio(stall("read"), "num_of_reads", 4).alias("avg_read_stall_ms"),
                         ratio(stall("write"), "num_of_writes", 4).alias("avg_write_stall_ms"))
