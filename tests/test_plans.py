"""Plan shapes against plain Python, with one key or value that holds most rows."""

import random
from itertools import accumulate

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.plans import forest, ordering, sequences, totals


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", rng.choice([5, 5, 5, rng.randrange(1000)]), i) for i in range(4000)]
    return rows


def test_rank_and_running_total_of_a_hot_group(spark, skewed):
    df = frame(spark, skewed, "k string, v long, id long")
    got = {(r.k, r.id): (r.rank, r.before) for r in ordering.add_rank(df, ["k"], ["-v", "id"], "rank", {"before": "v"}).collect()}
    for key in {k for k, _, _ in skewed}:
        ordered = sorted((r for r in skewed if r[0] == key), key=lambda r: (-r[1], r[2]))
        sums = [0, *accumulate(r[1] for r in ordered)]
        for i, r in enumerate(ordered):
            assert got[(key, r[2])] == (i + 1, sums[i])


def test_rank_without_scope_splits_equal_values(spark, skewed):
    df = frame(spark, skewed, "k string, v long, id long")
    ranged = ordering.with_ranges(df, [], ["-v", "id"])
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) > 30 and max(sizes) < len(skewed) / 10
    got = [r.id for r in ordering.add_rank(df, [], ["-v", "id"]).orderBy("rank").collect()]
    assert got == [r[2] for r in sorted(skewed, key=lambda r: (-r[1], r[2]))]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.one_of(st.none(), st.integers(-50, 50))), max_size=40))
def test_rank_property(spark, rows):
    rows = [(k, v, i) for i, (k, v) in enumerate(rows)]
    df = frame(spark, rows, "k string, v long, id long")
    got = {(r.k, r.id): r.rank for r in ordering.add_rank(df, ["k"], ["-v", "id"]).collect()}
    for key in ("a", "b"):
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        assert [got[(key, r[2])] for r in ordered] == list(range(1, len(ordered) + 1))


def test_empty_input(spark):
    df = frame(spark, [], "k string, v long, id long")
    assert ordering.add_rank(df, ["k"], ["-v", "id"]).count() == 0
    assert ordering.add_rank(df, [], ["-v", "id"], "rank", {"s": "v"}).count() == 0
    assert sequences.with_previous(df, ["k"], ["id"], ["v"], F.col("id")).count() == 0
    assert totals.with_totals(df, [], {"t": F.sum("v")}).count() == 0


def test_top_percent_rounds_up(spark):
    df = frame(spark, [(i, i) for i in range(21)], "v long, id long")
    assert sorted(r.v for r in ordering.top_percent(df, [], ["-v", "id"], 10).collect()) == [18, 19, 20]


def test_neighbours_across_buckets(spark):
    rows = [("a", t, t * 10) for t in (1, 2, 13, 14, 45, 46, 47)] + [("b", 5, 50)]
    df = frame(spark, rows, "k string, t long, v long")
    bucket = F.floor(F.col("t") / 10)
    back = {(r.k, r.t): r.prev_v for r in sequences.with_previous(df, ["k"], ["t"], ["v"], bucket).collect()}
    ahead = {(r.k, r.t): r.next_v for r in sequences.with_next(df, ["k"], ["t"], ["v"], bucket).collect()}
    ts = [1, 2, 13, 14, 45, 46, 47]
    assert [back[("a", t)] for t in ts] == [None, 10, 20, 130, 140, 450, 460]
    assert [ahead[("a", t)] for t in ts] == [20, 130, 140, 450, 460, 470, None]
    assert back[("b", 5)] is None and ahead[("b", 5)] is None


def test_previous_keeps_a_null_of_the_row_before(spark):
    df = frame(spark, [("a", 1, 7), ("a", 2, None), ("a", 3, 9)], "k string, t long, v long")
    got = {r.t: r.prev_v for r in sequences.with_previous(df, ["k"], ["t"], ["v"], F.col("t")).collect()}
    assert got == {1: None, 2: 7, 3: None}


def test_delta_is_null_after_a_reset(spark):
    df = frame(spark, [("a", 1, 100), ("a", 2, 150), ("a", 3, 20), ("a", 4, 20)], "k string, t long, v long")
    got = [r.v_delta for r in sequences.counter_delta(df, ["k"], ["t"], ["v"], F.floor(F.col("t") / 2)).orderBy("t").collect()]
    assert got == [None, 50, None, 0]


def test_next_value_looks_past_empty_buckets(spark):
    df = frame(spark, [(i, "x" if i == 95 else None) for i in range(100)], "t long, n string")
    got = sequences.with_next_value(df, [], ["t"], F.col("n"), F.floor(F.col("t") / 10), "next").orderBy("t").collect()
    assert [r.next for r in got] == ["x"] * 95 + [None] * 5


def test_state_as_of_takes_the_change_at_the_same_time(spark):
    changes = frame(spark, [("a", 10, "up"), ("a", 35, "down")], "k string, t long, state string")
    samples = frame(spark, [("a", 5, 1), ("a", 10, 2), ("a", 30, 3), ("a", 99, 4), ("b", 1, 5)], "k string, t long, id long")
    got = {r.id: r.state for r in sequences.state_as_of(samples, changes, ["k"], "t", ["state"], F.floor(F.col("t") / 7)).collect()}
    assert got == {1: None, 2: "up", 3: "up", 4: "down", 5: None}


def descend(parent):
    """Reference: rows below each row, cycle-safe."""
    children = {}
    for n, p in parent.items():
        if p and p != n:
            children.setdefault(p, []).append(n)
    out = {}
    for top in parent:
        seen, todo = {top}, [top]
        while todo:
            for c in children.get(todo.pop(), []):
                if c not in seen:
                    seen.add(c)
                    todo.append(c)
        out[top] = len(seen) - 1
    return out


@pytest.mark.parametrize("parent", [
    {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 9: 8},
    {1: 0, 2: 1, 3: 1, 4: 3, 5: 0, 6: 99},
    {1: 2, 2: 3, 3: 1, 4: 3, 5: 4, 6: 5, 7: 6, 8: 0, 9: 9, 10: 9},
    {1: 2, 2: 1, 3: 4, 4: 3, 5: 0},
    {1: 0},
], ids=["chain", "forest", "cycle with a tail", "two cycles", "single"])
def test_descendant_counts(spark, parent):
    df = frame(spark, list(parent.items()), "n long, p long")
    got = {r.node: r.descendants for r in forest.descendant_counts(df, [], "n", "p").collect()}
    assert got == descend(parent)


def test_deep_chain_and_cycle_paths(spark):
    parent = {i: i - 1 for i in range(1, 300)} | {1000: 1001, 1001: 1000, 1002: 1000}
    df = frame(spark, list(parent.items()), "n long, p long")
    got = {r.node: r.path for r in forest.paths_from_roots(df, [], "n", "p").collect()}
    assert got[299] == list(range(1, 300))
    assert set(got) == set(range(1, 300))


def test_totals_join_per_scope(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("b", 5)], "k string, v long")
    got = sorted((r.k, r.v, r.t) for r in totals.with_totals(df, ["k"], {"t": F.sum("v")}).collect())
    assert got == [("a", 1, 3), ("a", 2, 3), ("b", 5, 5)]


def test_rank_keeps_null_scopes(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), (None, 3)], "s string, v int")
    got = sorted(((r.s or "", r.v, r.rank) for r in ordering.add_rank(df, ["s"], ["-v"]).collect()))
    assert got == [("", 1, 2), ("", 3, 1), ("a", 2, 1)]
    from pyspark.sql import functions as F

    got = {(r.s, r.v): r.t for r in totals.with_totals(df, ["s"], {"t": F.sum("v")}).collect()}
    assert got == {(None, 1): 4, (None, 3): 4, ("a", 2): 2}


def test_previous_row_of_a_null_key(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(None, 1, 10), (None, 11, 30), ("a", 2, 5)], "k string, t int, v int")
    got = {(r.k, r.t): r.v_delta for r in sequences.counter_delta(df, ["k"], ["t"], ["v"], F.floor(F.col("t") / 10)).collect()}
    assert got == {(None, 1): None, (None, 11): 20, ("a", 2): None}


def test_repeated_sessions_are_one_node(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (2, None), (3, 2), (4, 3)], "n long, p long")
    assert {r.node: r.descendants for r in forest.descendant_counts(df, [], "n", "p").collect()} == {1: 3, 2: 2, 3: 1, 4: 0}
    assert {r.node: r.path for r in forest.paths_from_roots(df, [], "n", "p").collect()} == {1: [1], 2: [1, 2], 3: [1, 2, 3], 4: [1, 2, 3, 4]}


def test_memory_tree_has_all_levels(spark):
    from fleetlens.operators.cpu_memory import memory_tree

    chain = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}", 100 - i) for i in range(9)], "id long, parent_id long, name string, amount long")
    assert sorted(r.level for r in memory_tree(chain).collect()) == list(range(9))


def test_forests_of_a_member_without_a_name(spark):
    from fleetlens.operators.sessions import blocked_session_count, blocking_tree

    chain = [(k, i, i - 1, f"t{i}") for k in ("a", None) for i in range(1, 9)] + [(k, i, j, "ring") for k in ("a", None) for i, j in ((21, 22), (22, 23), (23, 21), (24, 21))]
    df = spark.createDataFrame(chain, "instance_id string, session_id long, blocking_session_id long, text string")
    counts = {(r.instance_id, r.session_id): r.blocked_session_count for r in blocked_session_count(df).collect()}
    want = {i: 8 - i for i in range(1, 9)} | {21: 3, 22: 3, 23: 3, 24: 0}
    assert counts == {(k, i): n for k in ("a", None) for i, n in want.items()}
    tree = {(r.instance_id, r.session_id): r.level for r in blocking_tree(df).collect()}
    assert tree == {(k, i): i - 1 for k in ("a", None) for i in range(1, 9)}
