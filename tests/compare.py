"""Compare registered queries with their check SQL in DuckDB.

python -m tests.compare [sf] [name-part ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

DATA = os.environ.get("FLEETLENS_TESTDATA", "/root/testdata")
SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
               "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "date": "DATE"}


def spark_session(cores: int = 8):
    from pyspark.sql import SparkSession

    # results must not depend on the time zone or the number of partitions
    zone = os.environ.get("FLEETLENS_TEST_ZONE", "UTC")
    partitions = os.environ.get("FLEETLENS_TEST_PARTITIONS", str(cores))
    return (SparkSession.builder.master(f"local[{cores}]").appName("fleetlens")
            .config("spark.sql.shuffle.partitions", partitions).config("spark.sql.session.timeZone", zone)
            .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
            .config("spark.sql.adaptive.enabled", "true").getOrCreate())


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


def order(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def duck(sf):
    from fleetlens.catalog.registry import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    return con


def check(spark, con, sf, name, build, sql):
    """Problems of one query as text; empty when it agrees."""
    df = build(spark, f"{DATA}/{sf}")
    cols = sorted(df.columns)
    rows = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    if sql is None:
        return [], len(rows)
    rel = con.sql(sql)
    problems = []
    if sorted(rel.columns) != cols:
        return [f"columns {sorted(set(cols) ^ set(rel.columns))}"], len(rows)
    types = dict(zip(rel.columns, map(str, rel.types)))
    for n, t in df.dtypes:
        want = SPARK_TYPES.get(t, t)
        if types[n] != want:
            problems.append(f"type {n}: {t} against {types[n]}")
    pos = [rel.columns.index(x) for x in cols]
    want = [tuple(plain(r[p]) for p in pos) for r in rel.fetchall()]
    if len(rows) != len(want):
        problems.append(f"rows {len(rows)} against {len(want)}")
    a, b = sorted(rows, key=order), sorted(want, key=order)
    if a != b:
        missing, extra = list(set(b) - set(a)), list(set(a) - set(b))
        problems.append(f"values: {len(extra)} differ\n  cols  {cols}\n  spark {extra[:2]}\n  duck  {missing[:2]}")
    return problems, len(rows)


def main(argv):
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as e

    sf = argv[0] if argv else "sf0.01"
    parts = argv[1:]
    spark = spark_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    checks, bad = e.oracle_sql(), 0
    for name, build in e.queries().items():
        if parts and not any(name.startswith(p) for p in parts):
            continue
        t0 = time.time()
        try:
            problems, n = check(spark, con, sf, name, build, checks.get(name))
        except Exception as ex:  # report and go on with the next query
            problems, n = [f"{type(ex).__name__}: {str(ex)[:1500]}"], -1
        spark.catalog.clearCache()
        bad += bool(problems)
        kind = "ok" if name in checks else "rows"
        print(f"{'BAD' if problems else kind:4} {name} rows={n} {time.time() - t0:.1f}s")
        for p in problems:
            print("    ", p)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
