"""Operators on small hand-made telemetry: worked examples, ties, zeros, resets, missing sides."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import columns as fc
from fleetlens.functions.wait_lists import EDITIONS
from fleetlens.operators import amplify, availability, backup, cpu_memory, file_io, index_catalog as ic, jobs, requests, rules, security, sessions, storage, waits

NOW = "2024-06-01 12:00:00"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


# ---- expressions ----------------------------------------------------------------


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_whole_number_division_truncates(spark):
    assert one(spark, fc.int_div(F.lit(7), F.lit(2)), fc.int_div(F.lit(-7), F.lit(2)), fc.int_div(F.lit(7), F.lit(0)), fc.int_div0(F.lit(7), F.lit(0))) == (3, -3, None, 0)


def test_ratio_rounds_half_away_from_zero(spark):
    assert one(spark, fc.ratio(F.lit(1), F.lit(8), 2), fc.ratio(F.lit(-1), F.lit(8), 2), fc.ratio(F.lit(2), F.lit(3), 2, 100), fc.ratio(F.lit(1), F.lit(0))) == (0.13, -0.13, 66.67, None)


def test_boundaries_are_crossed_not_elapsed(spark):
    a, b = fc.as_time("2024-01-01 10:59:59"), fc.as_time("2024-01-01 11:00:01")
    assert one(spark, fc.minute_boundaries(a, b, "HOUR"), fc.minute_boundaries(a, b), fc.seconds_between(a, b)) == (1, 1, 2)


def test_agent_numbers(spark):
    when, secs, text = one(spark, fc.agent_timestamp(F.lit(20240203), F.lit(40506)), fc.agent_seconds(F.lit(1000203)), fc.agent_duration_text(F.lit(1000203)))
    assert when == dt.datetime(2024, 2, 3, 4, 5, 6) and secs == 360123 and text == "100:02:03"


def test_elapsed_texts(spark):
    assert one(spark, fc.clock_text(F.lit(90061007)), fc.day_clock_text(F.lit(90061007)), fc.spoken_duration(F.lit(3725))) == ("01 01:01:01.007", "1d 01:01:01", "1 hour(s), 2 min, 5 sec")


def test_statement_offsets(spark):
    df = frame(spark, [("abcdef", 2, 6), ("abcdef", 2, -1), ("abcdef", 0, -1), ("ab", 0, 90)], "text string, a int, b int")
    assert [r[0] for r in df.select(fc.statement_text("text", "a", "b")).collect()] == ["bcd", "bcdef", "abcdef", "ab"]


# ---- waits ------------------------------------------------------------------------


def test_pareto_keeps_the_type_that_crosses_the_threshold(spark):
    df = frame(spark, [("a", 60, 6, 3), ("b", 30, 0, 1), ("c", 9, 0, 1), ("d", 1, 0, 1), ("z", 500, 0, 0), ("SLEEP_TASK", 900, 0, 9)],
               "wait_type string, wait_time_ms long, signal_wait_time_ms long, waiting_tasks_count long")
    got = waits.wait_pareto(df, 90, EDITIONS["server"])
    assert values(got, "wait_type", "rank", "wait_pct") == [("a", 1, 60.0), ("b", 2, 30.0)]
    assert values(waits.wait_pareto(df, 91, EDITIONS["server"]), "wait_type") == [("a",), ("b",), ("c",)]


def test_pareto_is_per_member(spark):
    df = frame(spark, [("i1", "a", 10, 0, 1), ("i2", "a", 1, 0, 1), ("i2", "b", 99, 0, 1)], "instance_id string, wait_type string, wait_time_ms long, signal_wait_time_ms long, waiting_tasks_count long")
    assert values(waits.wait_pareto(df, 50), "instance_id", "wait_type", "wait_pct") == [("i1", "a", 100.0), ("i2", "b", 99.0)]


def test_wait_info_formats(spark):
    df = frame(spark, [(1, "L", 5), (2, "L", 5), (2, "L", 9), (3, "L", 1), (3, "L", 2), (3, "L", 6)], "session_id long, wait_type string, wait_duration_ms long")
    assert values(waits.wait_info(df), "session_id", "wait_info") == [(1, "(1x: 5ms)L"), (2, "(2x: 5/9ms)L"), (3, "(3x: 1/3/6ms)L")]


def test_session_top_waits_text(spark):
    df = frame(spark, [(1, "a", 400), (1, "a", 300), (1, "b", 900), (1, "c", 500)], "session_id long, wait_type string, wait_time_ms long")
    assert values(waits.session_top_waits(df), "top_waits") == [("b (900 ms), a (700 ms)",)]


def test_edition_lists():
    assert {k: len(v) for k, v in EDITIONS.items()} == {"server": 97, "managed": 95, "cloud": 88, "classic": 76, "daily": 29}
    assert "HADR_FABRIC_CALLBACK" in EDITIONS["managed"] and "CXCONSUMER" not in EDITIONS["cloud"]


# ---- files ---------------------------------------------------------------------------


def test_idle_files(spark):
    stats = frame(spark, [(1, 1, 0, 0, 0, 0, 0, 0), (1, 2, 3, 1, 10, 9, 300, 100)],
                  "database_id int, file_id int, num_of_reads long, num_of_writes long, io_stall_read_ms long, io_stall_write_ms long, num_of_bytes_read long, num_of_bytes_written long")
    files = frame(spark, [(1, 1, "d:/a", 0, 128), (1, 2, "D:/b", 1, 256)], "database_id int, file_id int, physical_name string, type int, size long")
    assert values(file_io.file_latency(stats, files), "file_id", "avg_read_latency_ms", "size_mb") == [(1, 0.0, 1.0), (2, 2.5, 2.0)]
    assert values(file_io.drive_latency(stats, files), "drive", "read_latency", "write_latency", "avg_bytes_read") == [("D:", 3, 9, 100)]
    assert values(file_io.io_raw_latency(stats), "file_id", "avg_read_latency_ms") == [(1, None), (2, 3)]
    assert values(file_io.io_threshold_check(stats, files), "file_id", "max_read_stall_ms", "max_write_stall_ms", "write_wait") == [(2, 5, 2, "WRITELOG")]


# ---- indexes: the worked examples -------------------------------------------------------


def index_frames(spark, defs, columns="ABCDEFG"):
    """defs: index_id -> (type, unique, keys such as "A-BC", includes, filter)."""
    number = {c: i + 1 for i, c in enumerate(columns)}
    ix, cols = [], []
    for i, (kind, unique, keys, includes, where) in defs.items():
        ix.append((1, i, kind, unique, False, False, where))
        down = False
        ordinal = 0
        for ch in keys:
            if ch == "-":
                down = True
                continue
            ordinal += 1
            cols.append((1, i, number[ch], ordinal, down, False))
            down = False
        cols += [(1, i, number[ch], 0, False, True) for ch in includes]
    indexes = frame(spark, ix, "object_id long, index_id long, type int, is_unique boolean, is_primary_key boolean, is_unique_constraint boolean, filter_definition string")
    index_columns = frame(spark, cols, "object_id long, index_id long, column_id long, key_ordinal int, is_descending_key boolean, is_included_column boolean")
    table = frame(spark, [(1, n) for n in number.values()], "object_id long, column_id long")
    return indexes, index_columns, table


def lists(spark, defs, columns="ABCDEFG"):
    indexes, index_columns, table = index_frames(spark, defs, columns)
    return ic.index_column_lists(ic.physical_index_columns(indexes, index_columns, table), indexes)


def names(ids, columns="ABCDEFG"):
    return "".join(("-" if i < 0 else "") + columns[abs(i) - 1] for i in ids)


def test_physical_structure_of_the_example(spark):
    got = {r.index_id: (names(r.key_columns), names(r.include_columns)) for r in lists(spark, {
        1: (1, True, "ABCF", "", None), 2: (2, False, "BC", "DEA", None), 3: (2, True, "BC", "DEA", None)}).collect()}
    assert got[2] == ("BCAF", "DE")
    assert got[3] == ("BC", "ADEF")
    assert got[1] == ("ABCF", "DEG")


def test_duplicate_example(spark):
    df = ic.duplicate_indexes(lists(spark, {1: (2, False, "A-BC", "DFE", None), 2: (2, False, "A-BC", "FED", None), 3: (2, False, "ABC", "DFE", None)}))
    assert values(df, "index_id", "group_id", "group_count") == [(1, 1, 2), (2, 1, 2)]


def test_covered_example(spark):
    df = ic.covered_indexes(lists(spark, {1: (2, False, "A-BC", "DFE", None), 2: (2, False, "A-B", "FD", None)}))
    assert values(df, "index_id", "covered_index_id", "column_difference", "extra_columns") == [(1, 2, 2, "3,5")]


def test_mergeable_example(spark):
    defs = {1: (2, False, "A-BC", "DFE", None), 2: (2, False, "A-B", "FDG", None)}
    assert values(ic.mergeable_indexes(lists(spark, defs)), "index_id", "merged_index_id", "extra_column_count") == [(1, 2, 1)]
    assert ic.covered_indexes(lists(spark, defs)).count() == 0


def test_hidden_clustering_key_prevents_a_match(spark):
    df = ic.covered_indexes(lists(spark, {1: (1, True, "AB", "", None), 2: (2, False, "BC", "AEF", None), 3: (2, False, "B", "AF", None)}))
    assert (2, 3) not in values(df, "index_id", "covered_index_id")


def test_filters_must_agree_and_hierarchies_collapse(spark):
    defs = {1: (2, False, "ABC", "D", None), 2: (2, False, "AB", "D", None), 3: (2, False, "A", "", None), 4: (2, False, "A", "", "([A]=(1))")}
    assert values(ic.covered_indexes(lists(spark, defs)), "index_id", "covered_index_id") == [(1, 2), (1, 3)]


def test_unique_parent_needs_equal_keys(spark):
    defs = {1: (2, True, "AB", "CD", None), 2: (2, False, "A", "", None), 3: (2, False, "AB", "C", None)}
    assert values(ic.covered_indexes(lists(spark, defs)), "index_id", "covered_index_id") == [(1, 3)]


def test_copies_are_all_reported(spark):
    defs = {1: (2, False, "AB", "C", None), 2: (2, False, "AB", "C", None), 3: (2, False, "A", "", None), 4: (2, False, "A", "", None)}
    assert values(ic.covered_indexes(lists(spark, defs)), "index_id", "covered_index_id") == [(1, 3), (1, 4), (2, 3), (2, 4)]
    defs = {1: (2, False, "AB", "C", None), 2: (2, False, "AB", "C", None), 3: (2, False, "AB", "D", None)}
    assert values(ic.mergeable_indexes(lists(spark, defs)), "index_id", "merged_index_id") == [(1, 3), (2, 3)]


def test_a_third_of_all_indexes_may_be_copies(spark):
    defs = {i: (2, False, "AB", "C", None) for i in range(1, 400)} | {1000: (2, False, "ABD", "C", None)}
    assert ic.covered_indexes(lists(spark, defs)).count() == 399


def test_filter_terms_are_sorted(spark):
    df = frame(spark, [("([ColB] > 2 AND [ColA] = 1)",), ("([ColA] = 1)",), (None,)], "filter_definition string")
    assert [r[0] for r in ic.normalise_filter(df).collect()] == ["([ColA] = 1 AND [ColB] > 2)", "([ColA] = 1)", None]


# ---- sessions ------------------------------------------------------------------------------


def sessions_frame(spark, rows):
    return frame(spark, [(i, b, f"login{i}", st, tr) for i, b, st, tr in rows], "session_id long, blocking_session_id long, login_name string, status string, open_tran_count int")


def test_blocking_tree_text(spark):
    df = sessions_frame(spark, [(51, 0, "r", 0), (60, 51, "r", 0), (12345, 60, "r", 0), (70, 0, "r", 0), (80, 81, "r", 0), (81, 80, "r", 0)])
    got = [r.blocking_tree for r in sessions.blocking_tree(df).orderBy("path").collect()]
    assert got == ["    HEAD -  51", "    |         |------  60", "    |         |         |------  12345"]


def test_sleeping_levels_and_filters(spark):
    df = sessions_frame(spark, [(1, 0, "sleeping", 0), (2, 0, "sleeping", 1), (3, 0, "running", 0)])
    ids = lambda d: [r[0] for r in d.select("session_id").orderBy("session_id").collect()]
    assert ids(sessions.active_sessions(df, show_sleeping=0)) == [3]
    assert ids(sessions.active_sessions(df)) == [2, 3]
    assert ids(sessions.active_sessions(df, show_sleeping=2)) == [1, 2, 3]
    assert ids(sessions.active_sessions(df, include=("login", "login_"), exclude=("session", 3))) == [2]
    with pytest.raises(ValueError):
        sessions.active_sessions(df, show_sleeping=3)


def test_output_columns_keep_the_order_of_the_list(spark):
    df = frame(spark, [(1, 2, 3, 4)], "session_id int, cpu int, cpu_delta int, reads_delta int")
    assert sessions.select_output_columns(df, "[%delta][session_id][%]").columns == ["cpu_delta", "reads_delta", "session_id", "cpu"]
    with pytest.raises(ValueError):
        sessions.select_output_columns(df, "[session_id]", "[nothing] DESC")


def test_lock_documents_are_one_an_object(spark):
    df = spark.range(2500).select(F.lit(1).alias("request_session_id"), F.lit(2).alias("resource_database_id"), F.col("id").alias("resource_associated_entity_id"),
                                  F.lit("KEY").alias("resource_type"), F.lit("X").alias("request_mode"), F.lit("GRANT").alias("request_status"))
    docs = sessions.locks_document(df.unionAll(df)).collect()
    assert len(docs) == 2500 and {d.locks.count('"request_count":2') for d in docs} == {1}


def test_log_write_text(spark):
    tran = frame(spark, [(7, 1, 1, 2048, dt.datetime(2024, 1, 1)), (7, 2, 1, 1024, dt.datetime(2024, 1, 2)), (7, 3, 2, 512, dt.datetime(2023, 1, 1))],
                 "session_id long, transaction_id long, database_id int, log_bytes_used long, begin_time timestamp_ntz")
    names_ = frame(spark, [(1, "db1"), (2, "db2")], "database_id int, name string")
    assert values(sessions.transaction_log_writes(tran, names_), "tran_log_writes", "implicit_tran") == [("db1: 2 (3 kB), db2: 1 (0 kB)", "OFF")]


# ---- memory ---------------------------------------------------------------------------------


def test_memory_tree_from_counters(spark):
    rows = [("X:Memory Manager", "Target Server Memory (KB)", "", 10240), ("X:Memory Manager", "Total Server Memory (KB)", "", 8192), ("X:Memory Manager", "Stolen Server Memory (KB)  ", "", 4096),
            ("X:Memory Manager", "Lock Memory (KB)", "", 1024), ("X:Plan Cache", "Cache Pages", "_Total", 128), ("X:Plan Cache", "Cache Pages", "SQL Plans", 64), ("X:Buffer Manager", "Stolen pages", "", 999)]
    raw = frame(spark, rows, "object_name string, counter_name string, instance_name string, cntr_value long")
    clean = cpu_memory.normalise_counters(raw)
    assert ("Memory Manager", "Stolen Server Memory", 4.0) in values(clean, "object_name", "counter_name", "formatted_value")
    assert 999 not in [r.cntr_value for r in clean.collect()]
    tree = cpu_memory.memory_tree(cpu_memory.memory_nodes(clean), scale=100)
    got = {(r.id, r.name): (r.level, r.share_of_parent, r.share_of_root) for r in tree.collect()}
    assert got[(1000, "Target Server Memory")][0] == 0
    assert got[(1200, "Total Server Memory")] == (1, 0.8, None)
    assert got[(1220, "Stolen Server Memory")] == (2, 0.5, 0.4)
    assert got[(1222, "Lock Memory")][:2] == (3, 0.25)
    assert (1222, "<Other Memory Clerks>") in got


def test_page_life_minimum(spark):
    clean = frame(spark, [("Memory Manager", "Page life expectancy", "", 100, 100.0, "Page"), ("Memory Manager", "Database Cache Memory", "", 1, 8192.0, "Database")],
                  "object_name string, counter_name string, instance_name string, cntr_value long, formatted_value double, short_name string")
    assert values(cpu_memory.page_life_check(clean), "counter", "recommended_minimum") == [("Page life expectancy", 600)]


def test_memory_advice_steps(spark):
    def run(mb, setting):
        mem = frame(spark, [("i", mb * 1024)], "instance_id string, total_physical_memory_kb long")
        info = frame(spark, [("i", 512)], "instance_id string, max_workers_count long")
        conf = frame(spark, [("i", "max server memory (MB)", setting)], "instance_id string, name string, value long")
        sch = frame(spark, [("i", 0, 0, True)], "instance_id string, scheduler_id int, parent_node_id int, is_online boolean")
        return values(cpu_memory.max_memory_advice(mem, info, conf, sch), "os_reserve_mb", "recommended_mb", "alert")[0]

    assert run(16384, 1000) == (2560, 16384 - 2560 - 768, None)
    assert run(16384, 20000)[2] == "limit above what the host has"
    assert run(16384, 14000)[2] == "limit leaves the host too little"


# ---- storage, backup, jobs ---------------------------------------------------------------------


def test_volume_sample(spark):
    tb, gb = 1 << 40, 1 << 30
    df = frame(spark, [("LOGS03", int(15 * tb), int(15 * tb - 238.94 * gb)), ("TEMPDB01", int(99.87 * gb), int(12.63 * gb)), ("TEMPDB01", int(99.87 * gb), int(12.63 * gb))],
               "volume_mount_point string, total_bytes long, available_bytes long")
    got = {r.volume_mount_point: r for r in storage.volume_space(df).collect()}
    assert (got["LOGS03"].capacity, got["LOGS03"].used_space, got["LOGS03"].free_space) == ("  15.00 TB", " 238.94 GB", "  14.77 TB")
    assert got["LOGS03"].chart == "▒" * 50
    assert (got["TEMPDB01"].capacity, got["TEMPDB01"].free_pct) == ("  99.87 GB", 12.65)
    assert got["TEMPDB01"].chart == "█" * 43 + "▒" * 7


def test_vlf_ladder(spark):
    stats = frame(spark, [(i, 10000) for i in range(6)], "database_id int, vlf_count long")
    sizes = [50, 200, 900, 3000, 10000, 20000]
    files = frame(spark, [(i, "l", 1, mb * 128) for i, mb in enumerate(sizes)], "database_id int, name string, type int, size long")
    assert values(storage.vlf_target(stats, files), "database_id", "iterations", "potential_size_mb", "potential_vlf_count") == [
        (0, 1, 64, 4), (1, 1, 256, 8), (2, 2, 1024, 32), (3, 3, 3072, 48), (4, 2, 8192, 32), (5, 2, 16384, 32)]
    assert values(storage.vlf_target(stats, files, 10), "database_id", "potential_size_mb")[-2:] == [(4, 12000), (5, 24000)]


def test_backups_and_gaps(spark):
    day = dt.datetime(2024, 5, 30)
    sets = frame(spark, [(1, "D", 1, day, 1, 10), (1, "L", 2, day, 10, 20), (1, "L", 3, day + dt.timedelta(hours=1), 20, 30), (1, "L", 4, day + dt.timedelta(days=40), 31, 40)],
                 "database_id int, type string, backup_set_id long, backup_finish_date timestamp_ntz, first_lsn long, last_lsn long")
    dbs = frame(spark, [(1, "a"), (2, "b"), (3, "tempdb")], "database_id int, name string")
    assert values(backup.last_backups(dbs, sets, NOW), "name", "last_differential") == [("a", None), ("b", None)]
    assert values(backup.stale_backups(dbs, sets.where("backup_set_id < 4"), NOW), "database_id", "age_hours") == [(1, 59), (2, 9999)]
    assert values(backup.lsn_chain(sets, gaps_only=True), "backup_set_id") == [(4,)]


def test_schedule_texts(spark):
    df = frame(spark, [(4, 10, 1, 0, 1, 0, 40000, 235959), (8, 43, 4, 15, 3, 0, 10000, 170000), (16, 5, 8, 2, 3, 0, 0, 120000), (32, 1, 1, 0, 3, 1, 0, 0), (1, 0, 1, 0, 0, 0, 130000, 0)],
               "freq_type int, freq_interval int, freq_subday_type int, freq_subday_interval int, freq_recurrence_factor int, freq_relative_interval int, active_start_time int, active_end_time int")
    got = [(r.occurs, r.occurs_detail, r.frequency) for r in jobs.describe_schedules(df).collect()]
    assert got[0] == ("Daily", "Every 10 day(s)", "Occurs once at 04:00:00")
    assert got[1] == ("Weekly", "Every 3 week(s) on Sunday, Monday, Wednesday, Friday", "Occurs every 15 Minute(s) between 01:00:00 and 17:00:00")
    assert got[2][1] == "Day 5 of every 3 month(s)"
    assert got[3][1] == "The 1st Sun of every 3 month(s)"
    assert got[4] == ("Once", None, "Occurs once at 13:00:00")


# ---- rules ------------------------------------------------------------------------------------------


def test_rule_runner_keeps_every_finding(spark):
    rec = rules.recommended_settings(spark)
    conf = frame(spark, [("i1", "allow updates", 1), ("i1", "default trace enabled", 1), ("i2", "lightweight pooling", 1)], "instance_id string, name string, value long")
    drift = rules.config_drift(conf, rec)
    assert values(drift, "instance_id", "name") == [("i1", "allow updates"), ("i2", "lightweight pooling")]
    found = rules.run_rules([rules.finding(drift, "General", "Not recommended", "name", F.col("details")), rules.finding(conf.drop("instance_id").limit(1), "x", "y", "name", "z")])
    assert found.count() == 3


def test_login_burst_needs_enough_lines(spark):
    base = dt.datetime(2024, 6, 1, 11)
    df = frame(spark, [(base, "Login failed for x")] * 9, "log_date timestamp_ntz, log_text string")
    assert rules.login_failure_burst(df, NOW).count() == 0
    assert rules.login_failure_burst(df.union(df.limit(1)), NOW).count() == 10


def test_no_password_in_permission_export(spark):
    import inspect

    assert "password_hash" not in inspect.getsource(security)


# ---- availability, requests, amplifier ------------------------------------------------------------------


def test_failover_rules_are_ordered(spark):
    groups = frame(spark, [(1, "ag")], "group_id int, name string")
    reps = frame(spark, [(1, 1, "p"), (2, 1, "s2"), (3, 1, "s1")], "replica_id int, group_id int, replica_name string")
    roles = frame(spark, [(1, "PRIMARY", "CONNECTED"), (2, "SECONDARY", "CONNECTED"), (3, "SECONDARY", "DISCONNECTED")], "replica_id int, role_desc string, connected_state_desc string")
    db = frame(spark, [(1, 9, "SYNCHRONIZED", "HEALTHY", "ONLINE", False), (2, 9, "SYNCHRONIZED", "HEALTHY", "ONLINE", True), (3, 9, "SYNCHRONIZED", "HEALTHY", "ONLINE", False)],
               "replica_id int, database_id int, synchronization_state_desc string, synchronization_health_desc string, database_state_desc string, is_suspended boolean")
    cluster = frame(spark, [(1, 9, True), (2, 9, True)], "replica_id int, database_id int, is_failover_ready boolean")
    got = availability.failover_readiness(groups, reps, roles, db, cluster)
    assert values(got, "replica_name", "failover_status") == [("p", "READY FOR PLANNED FAILOVER"), ("s1", "Replica Disconnected"), ("s2", "Database Suspended")]
    assert {r.secondary_replicas for r in got.collect()} == {"s1, s2"}


def test_row_diff_names_the_missing_side(spark):
    art = frame(spark, [(1,), (2,), (3,)], "article_id int")
    pub, sub = frame(spark, [(1, 10), (2, 5)], "article_id int, row_count long"), frame(spark, [(1, 7)], "article_id int, row_count long")
    assert sorted(((r.article_id, r.row_difference, r.count_error) for r in availability.replication_row_diff(art, pub, sub).collect()), key=lambda r: r[0]) == [
        (1, 3, None), (2, None, "Subscriber: no count"), (3, None, "Publisher: no count | Subscriber: no count")]


def test_create_index_statement(spark):
    df = frame(spark, [(1, "[db].[s].[t]", "[a], [b]", "[c]", "[d]", 10, 0, 2.0, 50.0, dt.datetime(2024, 1, 1))],
               "group_handle long, statement string, equality_columns string, inequality_columns string, included_columns string, user_seeks long, user_scans long, avg_total_user_cost double, avg_user_impact double, last_user_seek timestamp_ntz")
    row = requests.missing_index_advice(df).first()
    assert row.benefit == 10.0
    assert row.create_index_statement.endswith("ON [db].[s].[t] ([a], [b],[c]) INCLUDE ([d])")
    assert "[IX_" in row.create_index_statement and "_a_b_c]" in row.create_index_statement


def test_amplifier_keeps_details_per_header(spark):
    head = frame(spark, [(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 1, 2))], "h long, d timestamp_ntz")
    det = frame(spark, [(1, "x"), (1, "y"), (2, "z"), (3, "lost")], "h long, what string")
    shifts = amplify.day_shifts(5)
    assert shifts == amplify.day_shifts(5) and len(set(shifts)) == 5
    big, lines = amplify.amplify_header(head, "h", ["d"], shifts), amplify.amplify_detail(det, head, "h", "h", shifts)
    assert big.select("new_h").distinct().count() == 10
    counts = {r.new_h: r["count"] for r in lines.groupBy("new_h").count().collect()}
    assert sorted(counts.values()) == [1] * 5 + [2] * 5 and set(counts) == {r.new_h for r in big.collect()}
