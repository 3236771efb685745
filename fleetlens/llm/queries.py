"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

OPERATORS = ("urls", "language", "sentencepiece", "near", "neighbours", "mixing", "lines", "tokens", "quality", "passages", "toxicity", "conversations", "hard_negatives")


def query(name: str, check: str | None = None):
    def wrap(build):
        assert name not in QUERIES, name
        QUERIES[name] = build
        if check is not None:
            CHECKS[name] = check
        return build

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for name in OPERATORS:
        import_module(f"fleetlens.llm.bound_{name}")
