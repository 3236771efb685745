"""The same queries with one customer, supplier, part and user that hold a third of the rows."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from fleetlens.catalog.registry import TABLES
from tests import compare

HOT = {
    "orders": "CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey",
    "lineitem": "CASE WHEN l_orderkey % 3 = 0 THEN 5 ELSE l_suppkey END AS l_suppkey, CASE WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN 11 ELSE l_partkey END AS l_partkey",
    "events": "CASE WHEN event_id % 3 = 0 THEN 3 ELSE user_id END AS user_id, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE event_type END AS event_type",
}
CHECKED = ("w4_session_top_waits", "w7_wait_delta", "io4_io_share_by_database", "q10_missing_index_advice", "q14_query_store_top_duration", "q24_connections_by_client", "q26_task_profile",
           "s2_session_delta", "s7_locks_document", "s10_transaction_log_writes", "m10_buffer_share_by_database", "i4_duplicate_indexes", "i5_covered_indexes", "i14_foreign_keys_without_index",
           "b4_lsn_chain", "j1_last_job_runs", "h14_mirroring_alerts", "r7_integrity_check_age", "t2_stream_counter_delta", "t5_blocking_episodes", "t9_state_as_of")


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    root = tmp_path_factory.mktemp("skew")
    (root / "hot").mkdir()
    con = duckdb.connect()
    for t in TABLES:
        columns = f"* REPLACE ({HOT[t]})" if t in HOT else "*"
        con.execute(f"COPY (SELECT {columns} FROM '{compare.DATA}/sf0.001/{t}.parquet') TO '{root}/hot/{t}.parquet' (FORMAT parquet)")
    return str(root)


@pytest.mark.parametrize("name", CHECKED)
def test_query_on_skewed_tables(spark, skewed, monkeypatch, name):
    monkeypatch.setattr(compare, "DATA", skewed)
    problems, _ = compare.check(spark, compare.duck("hot"), "hot", name, entry_points.queries()[name], entry_points.oracle_sql()[name])
    assert not problems, problems
