"""One registry for the queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

#: The largest join of the frames, and the keys that both sides of it are dealt by.
_LINES_MEET_ORDERS = "ON l_orderkey = o_orderkey"
_ORDER_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}

FRAMES: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def _words(text: str) -> set[str]:
    return set(re.findall(r"\w+", text))


def with_frames(sql: str) -> str:
    """Put the frames that a statement names in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(_words(text) & FRAMES.keys()):
            if name not in needed:
                visit(FRAMES[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ",\n".join(f"{n} AS ({FRAMES[n]})" for n in needed)
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def _zone_free(sql: str) -> str:
    """The frames mean zone-free timestamps, which is what DuckDB calls TIMESTAMP."""
    return re.sub(r"\bTIMESTAMP(?= '|\))", "TIMESTAMP_NTZ", sql)


class Tables:
    """The given tables and the frames derived from them, opened on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def sql(self, text: str) -> DataFrame:
        text = _zone_free(with_frames(text))
        lines_meet_orders = _LINES_MEET_ORDERS in text
        for name in _words(text) & set(TABLES):
            table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            if lines_meet_orders and name in _ORDER_KEYS:
                # all partitions of the session: joined again after a shuffle, their rows are too many for one task of
                # those that adaptive execution puts together by their size on the wire
                table = table.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), _ORDER_KEYS[name])
            table.createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if "bf_" + name in FRAMES:
            return self.sql(f"SELECT * FROM bf_{name}")
        raise AttributeError(name)


def query(name: str, check: str | None = None):
    """Register a function of `Tables` under a name, with its check SQL."""

    def wrap(build):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if check is not None:
            CHECKS[name] = with_frames(check)
        return build

    return wrap


def rounded(num: str, den: str, digits: int = 2, scale: int = 1) -> str:
    """SQL text for `scale * num / den` of whole numbers, rounded half away from zero."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    whole = f"(SIGN({n}) * ((2 * {scale * 10**digits} * ABS({n}) + NULLIF({d}, 0)) // (2 * NULLIF({d}, 0))))"
    return f"(CAST({whole} AS DOUBLE) / {float(10**digits)})"
