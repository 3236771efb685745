"""Landed views: round trip, latest snapshot, missing columns, logs and event files."""

import datetime as dt

from fleetlens.sources import readers

BASE = dt.datetime(2024, 3, 1, 10)


def waits(spark, rows):
    return spark.createDataFrame(rows, "instance_id string, collected_at timestamp_ntz, wait_type string, wait_time_ms long")


def test_round_trip_with_missing_columns_and_pruning(spark, tmp_path):
    readers.append_snapshots(waits(spark, [("i1", BASE, "a", 1), ("i2", BASE + dt.timedelta(days=1), "a", 2)]), str(tmp_path), "waits")
    readers.append_snapshots(waits(spark, [("i1", BASE + dt.timedelta(days=2), "a", 3)]), str(tmp_path), "waits")
    df = readers.read_view(spark, str(tmp_path), "waits")
    assert df.count() == 3 and df.where("waiting_tasks_count IS NULL").count() == 3
    part = readers.read_view(spark, str(tmp_path), "waits", instances=["i1"], since="2024-03-02")
    assert [r.wait_time_ms for r in part.collect()] == [3]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(collected_date" in plan and "In(instance_id" in plan or "EqualTo(instance_id" in plan


def test_latest_snapshot_per_member(spark):
    df = waits(spark, [("i1", BASE, "a", 1), ("i1", BASE + dt.timedelta(hours=1), "a", 2), ("i1", BASE + dt.timedelta(hours=1), "b", 3), ("i1", BASE + dt.timedelta(hours=9), "a", 4), ("i2", BASE, "a", 5)])
    got = readers.latest(df, "2024-03-01 12:00:00")
    assert sorted(r.wait_time_ms for r in got.collect()) == [2, 3, 5]


def test_errorlog_lines(spark, tmp_path):
    (tmp_path / "ERRORLOG").write_text("2024-01-02 03:04:05.67 spid9s      Server is listening on x\n   continued\n")
    (tmp_path / "ERRORLOG.3").write_text("2023-01-02 03:04:05.00 Logon       Login failed for y\n")
    got = {r.log_text: (r.log_date, r.process_info, r.log_number) for r in readers.read_errorlog(spark, str(tmp_path)).collect()}
    assert got["Server is listening on x"] == (dt.datetime(2024, 1, 2, 3, 4, 5, 670000), "spid9s", 0)
    assert got["Login failed for y"][1:] == ("Logon", 3)
    assert got["   continued"][0] is None


def test_event_files_give_one_row_per_event(spark, tmp_path):
    (tmp_path / "e.xml").write_text('<events>\n<event name="a"><data name="x"/></event>\n<event name="b">t\n</event>\n</events>')
    got = sorted(r.event_xml for r in readers.read_event_files(spark, str(tmp_path)).collect())
    assert got == ['<event name="a"><data name="x"/></event>', '<event name="b">t\n</event>']
