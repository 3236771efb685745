"""Interval joins against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.plans.intervals import overlap_join, state_by_intervals
from fleetlens.plans.sequences import state_as_of

BASE = dt.datetime(2024, 1, 1)


def intervals(seed, n):
    dice = random.Random(seed)
    out = []
    for i in range(n):
        start = BASE + dt.timedelta(microseconds=dice.randrange(10**9))
        length = dice.choice((0, 1, 17, 10**3, 10**6, 10**8, 10**9, 10**13))
        end = None if dice.random() < 0.05 else start + dt.timedelta(microseconds=dice.randrange(length + 1))
        if dice.random() < 0.05:
            start, end = end, start
        out.append((dice.choice(("a", "b", None)), i, start, end))
    return out


def overlap(a, b, a_inclusive, b_inclusive):
    (s, e), (t, f) = ((x[2], (x[3] or dt.datetime.max) - dt.timedelta(microseconds=0 if inclusive else 1)) if x[2] else (None, None) for x, inclusive in ((a, a_inclusive), (b, b_inclusive)))
    return s is not None and t is not None and s <= e and t <= f and s <= f and t <= e


@pytest.mark.parametrize("inclusive", [(False, False), (True, False), (True, True)])
def test_overlaps_against_brute_force(spark, inclusive):
    left, right = intervals(1, 150), intervals(2, 130)
    kinds = "k string, id long, s timestamp_ntz, e timestamp_ntz"
    got = overlap_join(spark.createDataFrame(left, kinds), spark.createDataFrame(right, kinds), ["k"], ("s", "e"), ("s", "e"), *inclusive)
    assert got.columns == ["k", "id", "s", "e", "other_id", "other_s", "other_e"]
    want = sorted((a[1], b[1]) for a in left for b in right if a[0] == b[0] and overlap(a, b, *inclusive))
    assert sorted((r.id, r.other_id) for r in got.collect()) == want


def test_long_intervals_stay_few_rows(spark):
    kinds = "k string, id long, s timestamp_ntz, e timestamp_ntz"
    years = spark.createDataFrame([("a", i, BASE, BASE + dt.timedelta(days=9000)) for i in range(20)], kinds)
    moments = spark.range(1000).select(F.lit("a").alias("k"), "id", F.timestamp_add("MINUTE", F.col("id"), F.lit(BASE).cast("timestamp_ntz")).alias("s")).withColumn("e", F.col("s"))
    assert overlap_join(moments, years, ["k"], ("s", "e"), ("s", "e"), left_inclusive=True).count() == 20_000


def test_states_by_intervals_equal_the_sequence_form(spark):
    dice = random.Random(5)
    moment = lambda: BASE + dt.timedelta(minutes=dice.randrange(3000))
    taken = {}
    for i in range(120):
        taken[dice.choice(("a", "b", None)), moment()] = dice.choice(("up", "down"))
    changes = spark.createDataFrame([(k, t, s) for (k, t), s in taken.items()], "k string, t timestamp_ntz, state string")
    rows = [(dice.choice(("a", "b", "none", None)), moment(), i % 50) for i in range(400)]
    samples = spark.createDataFrame(rows + rows[:5] + [("a", None, 1)], "k string, t timestamp_ntz, id long")
    got = state_by_intervals(samples, changes, ["k"], "t", ["state"], F.to_date("t"))
    want = state_as_of(samples.where("t IS NOT NULL"), changes, ["k"], "t", ["state"], F.to_date("t"))
    as_rows = lambda df: sorted((str(tuple(r)) for r in df.select("k", "t", "id", "state").collect()))
    assert as_rows(got.where("t IS NOT NULL")) == as_rows(want) and got.where("t IS NULL").count() == 1


def test_empty_sides(spark):
    kinds = "k string, id long, s timestamp_ntz, e timestamp_ntz"
    some, none = spark.createDataFrame(intervals(3, 10), kinds), spark.createDataFrame([], kinds)
    for a, b in ((some, none), (none, some), (none, none)):
        assert overlap_join(a, b, ["k"], ("s", "e"), ("s", "e")).count() == 0
