"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetlens.plans.checkpoints import shared_folder


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the session's checkpoint folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """The frame as written to the shared folder and read again.

    What comes after starts from files: it does not depend on shuffle blocks of executors that may be lost, the
    work before is not repeated by several readers, and sizes are known to the optimiser.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove settled frames that nothing reads any more: what was made of them is settled itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are settled: Spark removes them once the driver has collected its garbage."""
    spark.sparkContext._jvm.System.gc()
