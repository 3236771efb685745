"""Shares of a total without a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.joins import join_null_safe


def with_totals(df: DataFrame, scope: Sequence[str], totals: dict[str, Column], source: DataFrame | None = None) -> DataFrame:
    """Add one aggregate per `totals` entry, taken over the rows of the same scope.

    The aggregate combines on the map side. Without a scope it is a scalar
    subquery (one row, evaluated once); with a scope it is an equi join with one
    row per scope, which adaptive execution may broadcast or split.
    """
    source = df if source is None else source
    names = list(totals)
    aggs = [expr.alias(name) for name, expr in totals.items()]
    if not scope:
        one = source.agg(*aggs).select(F.struct(*names).alias("_totals"))
        out = df.withColumn("_totals", one.scalar())
        return out.select(*df.columns, *[F.col(f"_totals.{n}").alias(n) for n in names])
    per = source.groupBy(*scope).agg(*aggs)
    return join_null_safe(df, per, scope, "left").select(*df.columns, *names)

