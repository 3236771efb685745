"""Properties over many random members at once: every member is one case."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions.columns import fleet_keys
from fleetlens.operators import cpu_memory, file_io, waits
from fleetlens.plans.sequences import counter_delta


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    return {f"i{n}": [(f"w{j}", rng.choice([0, 1, 5, 5, rng.randrange(10000)]), rng.randrange(3)) for j in range(rng.randrange(1, 30))] for n in range(150)}


def waits_frame(spark, cases):
    rows = [(i, w, ms, ms // 3, n) for i, ws in cases.items() for w, ms, n in ws]
    return spark.createDataFrame(rows, "instance_id string, wait_type string, wait_time_ms long, signal_wait_time_ms long, waiting_tasks_count long")


@pytest.mark.parametrize("threshold", [1, 50, 99])
def test_pareto_is_the_smallest_prefix(spark, cases, threshold):
    kept = {}
    for r in waits.wait_pareto(waits_frame(spark, cases), threshold).collect():
        kept.setdefault(r.instance_id, []).append((r.rank, r.wait_type))
    for i, ws in cases.items():
        ordered = sorted(((w, ms) for w, ms, n in ws if n > 0), key=lambda x: (-x[1], x[0]))
        total, before, want = sum(ms for _, ms in ordered), 0, []
        for w, ms in ordered:
            if before * 100 < total * threshold:
                want.append(w)
            before += ms
        assert [w for _, w in sorted(kept.get(i, []))] == want


def test_shares_add_up(spark, cases):
    stats = waits_frame(spark, cases).select("instance_id", F.col("wait_type").alias("database_id"), (F.col("wait_time_ms") * 1048576).alias("num_of_bytes_read"), F.lit(0).cast("bigint").alias("num_of_bytes_written"))
    got = file_io.io_share_by_database(stats).groupBy("instance_id").agg(F.sum("total_pct").alias("p"), F.max("io_rank").alias("r"), F.count("*").alias("n")).collect()
    for r in got:
        assert r.r == r.n == len(cases[r.instance_id])
        if sum(ms for _, ms, _ in cases[r.instance_id]):
            assert abs(r.p - 100) < 0.01 * r.n


def test_deltas_are_never_negative(spark):
    rng = random.Random(5)
    rows = [(f"i{n}", t, rng.randrange(100)) for n in range(100) for t in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "instance_id string, t long, v long")
    got = {(r.instance_id, r.t): r.v_delta for r in counter_delta(df, ["instance_id"], ["t"], ["v"], F.floor(F.col("t") / 4)).collect()}
    by = {(i, t): v for i, t, v in rows}
    for (i, t), v in by.items():
        before = by.get((i, t - 1))
        assert got[(i, t)] == (None if before is None or v < before else v - before)


def test_recent_averages_use_what_there_is(spark):
    df = spark.createDataFrame([("a", t, t) for t in range(7)] + [("b", 1, 9)], "instance_id string, event_time long, process_utilization long")
    got = {r.instance_id: (r.avg_5, r.avg_30) for r in cpu_memory.cpu_recent_averages(df).collect()}
    assert got == {"a": (4, 3), "b": (9, 9)}


def test_frames_must_agree_on_members(spark):
    a, b = spark.createDataFrame([("i", 1)], "instance_id string, x int"), spark.createDataFrame([(1,)], "x int")
    assert fleet_keys(a, a) == ["instance_id"] and fleet_keys(b) == []
    with pytest.raises(ValueError):
        fleet_keys(a, b)
