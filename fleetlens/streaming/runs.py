"""Sources, sinks and runs of the streaming jobs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructField, StructType

from fleetlens.functions.columns import to_instant
from fleetlens.plans.checkpoints import shared_folder

#: Marks the rows that only say that a stream is over.
END = "_end"


def landed(spark: SparkSession, folder: str, schema: str, glob: str | None = None, files_per_batch: int | None = None, max_bytes_per_batch: str | None = None) -> DataFrame:
    """A stream over the parquet files of a folder, with a declared schema."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if max_bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_batch)
    return reader.parquet(folder)


def timed(stream: DataFrame, time: str, watermark: str) -> DataFrame:
    """Turn a zone-free time column into an instant with a watermark, which also sees the end of a closable stream."""
    out = stream.withColumn(time, to_instant(time)).withWatermark(time, watermark)
    if END not in stream.columns:
        return out
    # a filter below the watermark would drop the end before it is seen. None passes that names the time, so all columns
    # do; what the scan should filter is filtered before the stream is made closable
    kept = out.where(~F.col(END) | F.col(time).isNull())
    return kept.select(*[F.col(c) if c == time else F.when(~F.col(END) | F.col(time).isNotNull(), F.col(c)).alias(c) for c in stream.columns if c != END])


def _path(spark: SparkSession, folder: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def closable(stream: DataFrame, folder: str, time: str) -> DataFrame:
    """The stream and, beside it, the ends that `close` lands below the run's folder; to be `timed` next.

    A watermark only moves with rows. Without an end, what waits for it when the input runs dry (open windows,
    rows that may still get an earlier neighbour) waits on.
    """
    fs, path = _path(stream.sparkSession, f"{folder}/ends")
    fs.mkdirs(path)
    kind = StructType([StructField(time, stream.schema[time].dataType)])
    ends = stream.sparkSession.readStream.schema(kind).parquet(f"{folder}/ends")
    return stream.withColumn(END, F.lit(False)).unionByName(ends.withColumn(END, F.lit(True)), allowMissingColumns=True)


def close(stream: DataFrame, folder: str, time: str, until: str) -> None:
    """Say that no row before `until` less the watermark's delay is still to come. The next run takes it up."""
    spark = stream.sparkSession
    at = spark.range(1).select(F.lit(until).cast(stream.schema[time].dataType).alias(time))
    at.coalesce(1).write.mode("append").parquet(f"{folder}/ends")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in shared storage."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def stream_settings(spark: SparkSession, state_partitions: int | None = None):
    """Settings a stateful stream starts with, and keeps.

    Its `state_partitions` cannot be changed later: a run that will grow names them at its first start. By default
    there are two for each core, or fewer where the session shuffles into fewer; every one is a store that each
    micro-batch opens. Sessions are merged inside each task before they are shuffled, so one busy key sends few rows.
    """
    by_default = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    wanted = {"spark.sql.shuffle.partitions": str(state_partitions or by_default),
              "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
              "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, folder: str, mode: str = "append", partition_by: Sequence[str] = (), state_partitions: int | None = None):
    """Run a stream over everything that has landed and stop; the sink is `folder`/out.

    The file sink and the checkpoint make every input row count once, also when
    the run is repeated after a failure.
    """
    writer = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with stream_settings(stream.sparkSession, state_partitions):
        query = writer.start()
    query.awaitTermination()
    return query


def result(spark: SparkSession, folder: str) -> DataFrame:
    """What a run wrote."""
    return spark.read.parquet(f"{folder}/out")


def with_day(df: DataFrame, time: str = "collected_at") -> DataFrame:
    return df.withColumn("collected_date", F.to_date(time))
