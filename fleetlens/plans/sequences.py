"""Neighbouring rows of a sequence, safe against one key that holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.plans.joins import join_null_safe


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                  bucket: Column, prefix: str = "prev_") -> DataFrame:
    """Add the values of the row before, per key, in ascending `order`.

    `bucket` must not decrease along `order` (a day, a number range). The window
    runs inside one (key, bucket); the last row of each bucket is found by an
    aggregate and handed to the first row of the next non-empty bucket, so a key
    of any has spread over its buckets.
    """
    keys, order = list(keys), list(order)
    return _neighbour(df, keys, order, list(columns), bucket, prefix, forward=False)


def with_next(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
              bucket: Column, prefix: str = "next_") -> DataFrame:
    """Add the values of the row after, per key; see `with_previous`."""
    return _neighbour(df, list(keys), list(order), list(columns), bucket, prefix, forward=True)


def _neighbour(df, keys, order, columns, bucket, prefix, forward):
    step, edge = (F.lead, F.min_by) if forward else (F.lag, F.max_by)
    cut = df.withColumn("_bucket", bucket)
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    rows = cut.withColumn("_near", step(F.struct(*columns)).over(local))
    edges = cut.groupBy(*keys, "_bucket").agg(edge(F.struct(*columns), F.struct(*order)).alias("_edge"))
    per_key = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket")
    carried = edges.withColumn("_far", step("_edge").over(per_key)).drop("_edge")
    near = F.coalesce(F.col("_near"), F.col("_far"))
    out = join_null_safe(rows, carried, [*keys, "_bucket"], "left").withColumn("_near", near)
    return out.select(*df.columns, *[F.col(f"_near.`{x}`").alias(prefix + x) for x in columns])


def counter_delta(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], bucket: Column) -> DataFrame:
    """Growth of each counter since the row before; NULL for the first row and
    after a reset (a value smaller than the one before)."""
    out = with_previous(df, keys, order, values, bucket)
    for v in values:
        grown = F.col(v) - F.col(f"prev_{v}")
        out = out.withColumn(f"{v}_delta", F.when(grown >= 0, grown))
    return out


def with_next_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, bucket: Column, name: str) -> DataFrame:
    """Add the first non-null `value` of the rows after each row, per key.

    Like `with_next`, but it looks past any number of rows: what a bucket cannot
    answer itself comes from the first later bucket that has a value.
    """
    return _value(df, list(keys), list(order), value, bucket, name, forward=True)


def with_previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, bucket: Column, name: str) -> DataFrame:
    """Add the last non-null `value` of the rows before each row, per key; see `with_next_value`."""
    return _value(df, list(keys), list(order), value, bucket, name, forward=False)


def _value(df, keys, order, value, bucket, name, forward):
    pick, edge = (F.first, F.min_by) if forward else (F.last, F.max_by)

    def frame(window):
        return window.rowsBetween(1, Window.unboundedFollowing) if forward else window.rowsBetween(Window.unboundedPreceding, -1)

    cut = df.withColumn("_bucket", bucket).withColumn("_value", value)
    local = frame(Window.partitionBy(*keys, "_bucket").orderBy(*order))
    rows = cut.withColumn("_near", pick("_value", ignorenulls=True).over(local))
    found = F.when(F.col("_value").isNotNull(), F.struct(*order))
    edges = cut.groupBy(*keys, "_bucket").agg(edge("_value", found).alias("_edge"))
    others = frame(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket"))
    carried = edges.withColumn("_far", pick("_edge", ignorenulls=True).over(others)).drop("_edge")
    out = join_null_safe(rows, carried, [*keys, "_bucket"], "left")
    return out.select(*df.columns, F.coalesce("_near", "_far").alias(name))


def state_as_of(samples: DataFrame, changes: DataFrame, keys: Sequence[str], time: str, state: Sequence[str], bucket: Column) -> DataFrame:
    """Each sample with the state that the last change at or before it set.

    Changes and samples are put in one sequence per key, so no sample is ever
    paired with more than one change. `samples` has one row per key, time and
    its other columns.
    """
    keys, state = list(keys), list(state)
    rest = [x for x in samples.columns if x not in keys and x != time]
    a = changes.select(*keys, time, F.struct(*state).alias("_set"), F.lit(0).alias("_kind"), F.lit(None).cast(samples.select(F.struct(*rest)).schema[0].dataType).alias("_row"))
    b = samples.select(*keys, time, F.lit(None).cast(a.schema["_set"].dataType).alias("_set"), F.lit(1).alias("_kind"), F.struct(*rest).alias("_row"))
    out = with_previous_value(a.unionByName(b), keys, [time, "_kind"], F.col("_set"), bucket, "_state").where(F.col("_kind") == 1)
    return out.select(*keys, time, *[F.col(f"_row.`{x}`").alias(x) for x in rest], *[F.col(f"_state.`{x}`").alias(x) for x in state])
