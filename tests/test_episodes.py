"""Episodes end where their check SQL ends them."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from fleetlens.catalog import load
from fleetlens.catalog.registry import CHECKS, QUERIES

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("name, gap", [("p53_jobs_during_blocking", dt.timedelta(minutes=5)), ("t5_blocking_episodes", dt.timedelta(hours=12))])
def test_a_sample_a_whole_gap_after_the_last_starts_an_episode(spark, tmp_path, name, gap):
    load()
    micro = dt.timedelta(microseconds=1)
    at = [START]
    for step in (gap, gap - micro, gap, gap + micro, gap - micro, gap - micro, gap):
        at.append(at[-1] + step)
    samples = [(i, t, 7, "click", float(i)) for i, t in enumerate(at)]
    jobs = [(100 + i, t, 7, "purchase", v) for i, t in enumerate(at) for v in (0.01, 30.0)]
    rows = [(*r[:4], r[4], "{}") for r in samples + [(100 + i, *r[1:]) for i, r in enumerate(jobs)]]
    kinds = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()), ("value", pa.float64()), ("props", pa.string())])
    table = pa.table([list(c) for c in zip(*(rows if name.startswith("p53") else rows[:len(samples)]))], schema=kinds)
    pq.write_table(table, tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.sql(CHECKS[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
