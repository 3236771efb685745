"""The compiled health check: every rule fires, and every source table is scanned once."""

import datetime as dt

from fleetlens.catalog import load
from fleetlens.catalog.registry import QUERIES
from fleetlens.operators import health
from fleetlens.operators.health import RULES, Rule, compile_rules

DATA = "/root/testdata/sf0.001"


def test_rules_of_a_source_are_one_projection(spark):
    frame = spark.createDataFrame([("a", 5), ("b", None), (None, 50)], "name string, n int").withColumn("instance_id", health.F.lit(7))
    rules = [Rule("s", "n > 3", "'c'", "'big'", "name", "concat('n is ', n)"), Rule("s", "n > 30", "'c'", "'huge'", "name", "'more'"), Rule("other", "true", "'c'", "'x'", "name", "'x'"),
             Rule("s", "x > n", "'c'", "'each'", "name", "x", each="sequence(n, n + 1)")]
    got = sorted(map(tuple, compile_rules({"s": frame}, rules).collect()), key=str)
    assert got == sorted([(7, "c", "big", "a", "n is 5"), (7, "c", "big", None, "n is 50"), (7, "c", "huge", None, "more"), (7, "c", "each", "a", "6"), (7, "c", "each", None, "51")], key=str)
    plan = compile_rules({"s": frame.repartition(2)}, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.count("Union") == 0


def test_every_rule_fires_and_an_unremarkable_instance_has_no_finding(spark):
    now = dt.datetime(2024, 2, 1)
    bad = {
        "databases": health.database_source(
            spark.createDataFrame([(1, "x", "ONLINE", True, True, False, False, "NONE", 130, "gone"), (2, "y", "OFFLINE", False, False, True, True, "CHECKSUM", 150, "me")],
                                  "database_id int, name string, state_desc string, is_auto_close_on boolean, is_auto_shrink_on boolean, is_auto_create_stats_on boolean, is_auto_update_stats_on boolean, page_verify_option_desc string, compatibility_level int, owner_sid string"),
            spark.createDataFrame([("me",)], "sid string"), spark.createDataFrame([(2, "L", now - dt.timedelta(days=3))], "database_id int, type string, backup_finish_date timestamp_ntz"), "2024-02-01 00:00:00"),
        "files": health.file_source(spark.createDataFrame([(2, 1, 0, 10, True, "c:/t1"), (2, 2, 0, 0, False, "d:/t2")], "database_id int, file_id int, type int, growth int, is_percent_growth boolean, physical_name string")),
        "settings": health.settings_source(spark.createDataFrame([("affinity mask", 1), ("affinity I/O mask", 3), ("blocked process threshold (s)", 2), ("index create memory (KB)", 5), ("min memory per query (KB)", 9), ("max worker threads", 4000),
                                                                  ("allow updates", 1), ("clr enabled", 1), ("default trace enabled", 1)], "name string, value int")),
        "facts": spark.createDataFrame([("1433", 0, False, "Standard", "a", "b")], "tcp_port string, audit_level int, agent_running boolean, edition string, server_name string, actual_server_name string"),
        "principals": spark.createDataFrame([("0x01", "sa", False)], "sid string, name string, is_disabled boolean"),
        "stores": health.store_source(spark.createDataFrame([("x", 1, 0, "ERROR", "READ_WRITE")], "database_name string, query_capture_mode int, size_based_cleanup_mode int, actual_state_desc string, desired_state_desc string"), spark.createDataFrame([], "database_name string")),
        "suspect_pages": health.page_source(spark.createDataFrame([(1, 1, 9, 2, 4, now)], "database_id int, file_id int, page_id int, event_type int, error_count int, last_update_date timestamp_ntz")),
        "foreign_keys": spark.createDataFrame([(5, "fk", True, False)], "constraint_object_id int, name string, is_not_trusted boolean, is_disabled boolean"),
        "checks": spark.createDataFrame([(6, "ck", True, False)], "constraint_object_id int, name string, is_not_trusted boolean, is_disabled boolean"),
        "dumps": spark.createDataFrame([("d.mdmp", now)], "filename string, creation_time timestamp_ntz"),
        "mail": health.mail_source(spark.createDataFrame([(3, "error", now, "no route")], "mailitem_id int, event_type string, log_date timestamp_ntz, description string"), "2024-02-01 00:00:00"),
        "logs": health.log_source(spark.createDataFrame([("agent", 0, 300 << 20), ("agent", 1, 1)], "log_kind string, archive_no int, size_bytes long")),
    }
    assert set(bad) == {r.source for r in RULES}
    found = compile_rules(bad).collect()
    # the rule on temporary files names both of them
    assert len(found) == len(RULES) + 1 and None not in {x for r in found for x in r}
    fine = {"facts": spark.createDataFrame([("5000", 2, True, "Standard", "a", "a")], bad["facts"].schema), "principals": spark.createDataFrame([("0x01", "sa", True)], bad["principals"].schema)}
    assert compile_rules(fine).count() == 0


def test_each_table_is_scanned_once(spark):
    load()
    plan = QUERIES["r1_health_check"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    # the frames derive their sources from the given tables; the second look at temporary files is the only other scan
    own = sum("Generate explode(filter(" in line for line in plan.splitlines())
    assert own == len({r.source for r in RULES})
