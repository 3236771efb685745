"""What grows with the input is neither sent through the driver nor differs from the SQL on larger tables."""

import datetime as dt

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from fleetlens.operators import requests as q
from fleetlens.plans.intervals import state_by_intervals
from tests.compare import duck


def broadcasts(df):
    """The plan below each broadcast exchange, before any run."""
    text = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for i, line in enumerate(text):
        if "BroadcastExchange" in line:
            depth = line.index("Broadcast")
            below = []
            for other in text[i + 1:]:
                if len(other) - len(other.lstrip(" :+-*()0123456789")) <= depth:
                    break
                below.append(other)
            out.append("\n".join(below))
    return out


def test_exploded_intervals_are_not_broadcast(spark):
    start = dt.datetime(2024, 1, 1)
    moment = F.timestamp_add("MINUTE", F.col("id"), F.lit(start).cast("timestamp_ntz"))
    samples = spark.range(2000).select((F.col("id") % 7).alias("k"), moment.alias("t"), "id")
    changes = spark.range(300).select((F.col("id") % 7).alias("k"), F.timestamp_add("MINUTE", F.col("id") * 5, F.lit(start).cast("timestamp_ntz")).alias("t"), F.col("id").cast("string").alias("state"))
    got = state_by_intervals(samples, changes, ["k"], "t", ["state"], F.to_date("t"))
    assert not [x for x in broadcasts(got) if "Generate" in x]
    assert got.count() == 2000


def test_only_the_leaders_travel_to_their_documents(spark):
    stats = spark.range(500).selectExpr("id AS plan_handle", "0 AS database_id", "1L AS execution_count", "id AS total_worker_time", "current_timestamp() AS creation_time")
    texts = spark.range(500).selectExpr("id AS plan_handle", "concat('text ', id) AS text")
    plans = spark.range(500).selectExpr("id AS plan_handle", "concat('<MissingIndexes>', id) AS query_plan")
    got = q.top_queries(stats, texts, "worker_time", 5, plans)
    # a side with documents is first cut down to the leaders
    sides = [x for x in broadcasts(got) if "text " in x or "MissingIndexes" in x]
    assert all("LeftSemi" in x for x in sides), sides
    rows = sorted((r.plan_handle, r.short_query_text, r.has_missing_index) for r in got.collect())
    assert rows == [(i, f"text {i}", 1) for i in range(495, 500)]


def test_messages_of_a_larger_table_as_in_the_sql(spark):
    got = {r.message_id for r in entry_points.queries()["h7_ha_message_catalog"](spark, "/root/testdata/sf0.1").collect()}
    assert got == {r[0] for r in duck("sf0.1").sql(entry_points.oracle_sql()["h7_ha_message_catalog"]).fetchall()}


def test_a_tree_sends_no_level_through_the_driver(spark, monkeypatch):
    from fleetlens.operators import cpu_memory as m

    seen, cut = [], m.cut
    monkeypatch.setattr(m, "cut", lambda df: (seen.extend(broadcasts(df)), cut(df))[1])
    nodes = spark.range(1, 64).selectExpr("id", "CASE WHEN id > 1 THEN id div 2 END AS parent_id", "concat('n', id) AS name", "id * 10 AS amount")
    assert sorted(r.level for r in m.memory_tree(nodes).collect()) == sorted(i.bit_length() - 1 for i in range(1, 64))
    assert seen == []


def test_a_frequent_sort_value_is_spread_over_tasks(spark):
    from fleetlens.operators.sessions import select_output_columns

    rows = spark.range(20_000).selectExpr("id AS session_id", "id % 3 AS request_id", "IF(id = 7, 5L, NULL) AS tempdb_current", "'x' AS text")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = select_output_columns(rows, "[text][tempdb_current]", "[tempdb_current] DESC")
        parts = out.groupBy(F.spark_partition_id()).count().collect()
        assert out.columns == ["text", "tempdb_current"] and out.first().tempdb_current == 5
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in parts) < 10_000


def test_nodes_of_documents_are_not_broadcast(spark):
    from fleetlens.plans.trees import below, nodes

    docs = spark.range(30).selectExpr("id", "concat('<a><b n=\"', id, '\"/></a>') AS doc")
    # the plan after the run: adaptive execution must not choose a broadcast either
    found = nodes(docs, ["id"], "doc", ["a", "b"])
    got = below(found.where("name = 'a'"), found.where("name = 'b'"), ["id", "_text"], "outer", "inner")
    assert got.count() == 30
    got.collect()
    assert not broadcasts(got)
