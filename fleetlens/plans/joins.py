"""Joins on keys that may be null, and joins whose sides the optimiser misjudges.

Its estimates are those of compressed files: they know neither exploded rows nor texts that a query builds, so a side that
grows with the input may be sent through the driver to every task. Where both sides grow, they are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", grown: bool = False) -> DataFrame:
    """An equi join in which a null key meets a null key; the result has the keys once, from the left side.

    `<=>` is an equality to the optimiser, so rows are still hashed by the keys. With `grown`, see `join_grown`.
    """
    names = {k: f"_same_{k}" for k in keys}
    other = right.select(*[F.col(f"`{c}`").alias(names.get(c, c)) for c in right.columns])
    same = reduce(and_, [F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`")) for k, n in names.items()])
    out = left.join(other.hint("merge") if grown else other, same, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*names.values())


def join_grown(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """An equi join of two sides that both grow with the input: neither is broadcast, whatever its estimate."""
    return left.join(right.hint("merge"), list(keys), how)


def join_few(few: DataFrame, many: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Some chosen rows with their details: `many` is cut down to the keys of the `few` before anything of it travels."""
    chosen = few.select(*keys).distinct()
    return few.join(many.join(F.broadcast(chosen), list(keys), "left_semi"), list(keys), how)
