"""Enlarging a header and detail pair of tables."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_shifts(n: int = 40, seed: int = 42, limit: int = 1000) -> list[int]:
    """`n` different day shifts below `limit`, the same for the same seed."""
    return sorted(random.Random(seed).sample(range(limit), n))


def _new_key(key: str, n: int) -> Column:
    # copy i of key k gets k * n + i: unique, and the same for header and detail,
    # without ranking all rows
    return (F.col(key) * n + F.col("_copy")).alias(f"new_{key}")


def _copies(shifts: Sequence[int]) -> Column:
    return F.posexplode(F.array(*[F.lit(s) for s in shifts])).alias("_copy", "shift_days")


def amplify_header(header: DataFrame, key: str, dates: Sequence[str], shifts: Sequence[int]) -> DataFrame:
    """One copy of every header row per shift, with a new key and all dates moved."""
    out = header.select("*", _copies(shifts))
    for d in dates:
        out = out.withColumn(d, F.timestamp_add("DAY", F.col("shift_days"), F.col(d)))
    return out.select(_new_key(key, len(shifts)), *header.columns, "shift_days")


def amplify_detail(detail: DataFrame, header: DataFrame, detail_key: str, header_key: str, shifts: Sequence[int]) -> DataFrame:
    """The detail rows of every header copy, under the copy's key."""
    known = detail.join(header.select(F.col(header_key).alias(detail_key)), detail_key, "left_semi")
    return known.select("*", _copies(shifts)).select(_new_key(detail_key, len(shifts)), *detail.columns)
