"""Cutting the lineage of iterative plans in shared storage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """The checkpoint folder of the session: `spark.checkpoint.dir` where it is
    set. Only a local session may fall back to a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fleetlens-")
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the next round of an iteration reads files, not a growing plan."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
