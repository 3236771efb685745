"""The first percent of rows by selection against a sorted list."""

import functools
import math
import random

import pytest
from pyspark.sql import DataFrame

from fleetlens.plans import ordering
from fleetlens.plans.ordering import top_percent


def brute(rows, down, percent):
    """`rows`: (scope, value, id); null last downwards, first upwards."""
    out = []
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        mine.sort(key=lambda r: ((r[1] is None, -(r[1] or 0)) if down else (r[1] is not None, r[1] or 0)) + (r[2],))
        out += mine[:math.ceil(len(mine) * percent / 100)]
    return sorted(map(str, out))


def some(kind, n=3000):
    dice = random.Random(kind)
    value = {"spread": lambda: dice.randrange(10**12), "ties": lambda: dice.randrange(3), "same": lambda: 7, "nulls": lambda: None if dice.random() < 0.6 else dice.randrange(50), "none": lambda: None,
             "skewed": lambda: int(2 ** (dice.random() * 40))}[kind]
    return [(dice.choice(("a", "a", "a", "b", None)), value(), i) for i in range(n)]


@pytest.mark.parametrize("kind", ["spread", "ties", "same", "nulls", "none", "skewed"])
@pytest.mark.parametrize("keys", [["-v", "id"], ["v", "id"]])
def test_selection_with_scope(spark, kind, keys):
    rows = some(kind)
    df = spark.createDataFrame(rows, "k string, v long, id long")
    for percent in (1, 50, 100):
        got = top_percent(df, ["k"], keys, percent)
        assert got.columns == df.columns
        assert sorted(map(str, map(tuple, got.collect()))) == brute(rows, keys[0][0] == "-", percent)


def test_selection_over_all_rows_and_a_sketch_that_misses(spark, monkeypatch):
    rows = [("x", *r[1:]) for r in some("spread")]
    df = spark.createDataFrame(rows, "k string, v long, id long")
    assert sorted(map(str, map(tuple, top_percent(df, [], ["-v", "id"], 10).collect()))) == brute(rows, True, 10)
    # a bracket that lies beside the cut costs a larger ranking, not the result
    sketch = ordering.F.percentile_approx
    for wrong in (0.2, 0.8):
        monkeypatch.setattr(ordering.F, "percentile_approx", lambda v, ends, accuracy: sketch(v, ordering.F.array(ordering.F.lit(wrong), ordering.F.lit(wrong)), accuracy))
        got = top_percent(df, [], ["-v", "id"], 50)
        monkeypatch.undo()
        assert sorted(map(str, map(tuple, got.collect()))) == brute(rows, True, 50)


def test_texts_and_empty_frames(spark):
    df = spark.createDataFrame([("x", str(i), i) for i in range(10)], "k string, v string, id long")
    assert sorted(r.v for r in top_percent(df, ["k"], ["v", "id"], 30).collect()) == ["0", "1", "2"]
    assert top_percent(df.limit(0).selectExpr("k", "id AS v", "id"), ["k"], ["-v", "id"], 30).count() == 0


def test_the_bracket_does_not_depend_on_the_order_of_the_parts(spark):
    """Tasks hand in their sketches in any order, and each pass takes its own: all must see the same bracket."""
    rows = spark.range(120_000).selectExpr("'x' AS k", "pmod(xxhash64(id), 1000003) AS v", "id")
    chunks = [rows.where(f"id % 12 = {i}") for i in range(12)]
    ends = lambda parts, scope: ordering._bracket(functools.reduce(DataFrame.unionByName, parts).withColumn("_v", ordering.F.col("v").cast("double")), scope, ["-v", "id"], [0.1, 0.9]).collect()
    for scope in ([], ["k"]):
        assert ends(chunks, scope) == ends(chunks[::-1], scope) == ends(chunks[5:] + chunks[:5], scope)
