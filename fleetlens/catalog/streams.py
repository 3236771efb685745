"""Streaming queries over the given tables: each run drains `events` and returns its sink."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import FRAMES, query, rounded
from fleetlens.functions.columns import from_instant, to_instant
from fleetlens.plans.intervals import overlap_join, state_by_intervals
from fleetlens.plans.sequences import state_as_of
from fleetlens.streaming import operators as st
from fleetlens.streaming.runs import closable, close, drain, fresh_folder, landed, result, timed

R = rounded
SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def _gauge():
    return F.round(F.col("value") * 100).cast("bigint")


FRAMES.update(
    bf_state_changes="""SELECT user_id AS instance_id, ts AS collected_at, event_id AS change_id, event_type AS state FROM events WHERE event_type IN ('error', 'signup')""",
    bf_state_samples="""SELECT user_id AS instance_id, ts AS collected_at, event_id AS sample_id, CAST(ROUND(value * 100) AS BIGINT) AS gauge FROM events WHERE event_type NOT IN ('error', 'signup')""",
)


def _events(t):
    return landed(t.spark, t.sf_dir, SCHEMA, glob="events.parquet")


def _finish(t, stream, name):
    folder = fresh_folder(t.spark, name)
    drain(stream, folder)
    return result(t.spark, folder)


def _over(t) -> str:
    """A moment by which every window over the events has closed."""
    return str(t.events.agg(F.max("ts") + F.expr("INTERVAL 3 DAYS")).first()[0] or "1970-01-01 00:00:00")


def _finish_windows(t, windows, name):
    """Drain the events into windows, say that they are over, and drain again: the last windows are written too."""
    folder, events = fresh_folder(t.spark, name), _events(t)
    plan = windows(timed(closable(events, folder, "ts"), "ts", "10 minutes"))
    drain(plan, folder)
    close(events, folder, "ts", _over(t))
    drain(plan, folder)
    return result(t.spark, folder)


@query("t1_collect", "SELECT event_id, ts AS collected_at, user_id, event_type, value, props, CAST(ts AS DATE) AS collected_date FROM events")
def _(t):
    folder = fresh_folder(t.spark, "collect")
    st.collect(_events(t).withColumnRenamed("ts", "collected_at"), folder)
    return result(t.spark, folder)


@query("t2_stream_counter_delta", """
    WITH p AS (SELECT instance_id, metric, collected_at, event_id, counter_value, LAG(counter_value) OVER (PARTITION BY instance_id, metric ORDER BY collected_at, event_id) AS prev FROM bf_snapshots)
    SELECT * EXCLUDE (prev), CASE WHEN counter_value >= prev THEN counter_value - prev END AS counter_value_delta FROM p""")
def _(t):
    ts = F.col("ts")
    counter = (F.dayofmonth(ts) * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60).cast("bigint") + _gauge() * 20
    rows = _events(t).select(F.col("user_id").alias("instance_id"), F.col("event_type").alias("metric"), ts.alias("collected_at"), "event_id", counter.alias("counter_value"))
    folder = fresh_folder(t.spark, "delta")
    st.stream_counter_delta(rows, folder, ["instance_id", "metric"], ["collected_at", "event_id"], ["counter_value"], lateness="10 minutes", until=_over(t))
    return result(t.spark, folder)


@query("t3_utilisation_tumbling", f"""
    WITH w AS (SELECT event_type, TIME_BUCKET(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS window_start, CAST(ROUND(value * 100) AS BIGINT) AS g FROM events),
    a AS (SELECT event_type, window_start, window_start + INTERVAL 1 HOUR AS window_end, COUNT(*) AS samples, {R('SUM(g)', 'COUNT(*)', 2)} AS avg_value, MAX(g) AS max_value FROM w GROUP BY ALL)
    SELECT * FROM a""")
def _(t):
    return _finish_windows(t, lambda e: st.utilisation_tumbling(e.withColumn("gauge", _gauge()), "ts", "gauge", ["event_type"], "1 hour"), "tumbling")


@query("t4_utilisation_sliding", f"""
    WITH b AS (SELECT ts, CAST(ROUND(value * 100) AS BIGINT) AS g, TIME_BUCKET(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 00:00:00') AS last_start FROM events),
    w AS (SELECT last_start - TO_HOURS(6 * i) AS window_start, g FROM b, (VALUES (0), (1), (2), (3)) v(i)),
    a AS (SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, COUNT(*) AS samples, {R('SUM(g)', 'COUNT(*)', 2)} AS avg_value FROM w GROUP BY 1)
    SELECT * FROM a""")
def _(t):
    return _finish_windows(t, lambda e: st.utilisation_sliding(e.withColumn("gauge", _gauge()), "ts", "gauge", [], "24 hours", "6 hours"), "sliding")


@query("t5_blocking_episodes", f"""
    WITH e AS (SELECT user_id AS waiter_session_id, ts, CAST(ROUND(value * 100) AS BIGINT) AS wait_ms, CASE WHEN ts < LAG(ts) OVER w + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, SUM(fresh) OVER (PARTITION BY waiter_session_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS episode FROM e),
    a AS (SELECT waiter_session_id, MIN(ts) AS window_start, MAX(ts) + INTERVAL 12 HOUR AS window_end, COUNT(*) AS samples, MAX(wait_ms) AS max_wait_ms FROM g GROUP BY waiter_session_id, episode)
    SELECT * FROM a""")
def _(t):
    pairs = lambda e: e.select("ts", F.col("user_id").alias("waiter_session_id"), _gauge().alias("wait_ms"))
    return _finish_windows(t, lambda e: st.blocking_episodes(pairs(e), "ts", ["waiter_session_id"], gap="12 hours"), "episodes")


@query("t6_login_failure_alerts", f"""
    WITH a AS (SELECT TIME_BUCKET(INTERVAL 360 MINUTE, log_date, TIMESTAMP '1970-01-01 00:00:00') AS window_start, COUNT(*) AS failures FROM bf_errorlog WHERE log_text LIKE 'Login failed%' GROUP BY 1),
    b AS (SELECT window_start, window_start + INTERVAL 360 MINUTE AS window_end, failures FROM a WHERE failures >= 10)
    SELECT * FROM b""")
def _(t):
    text = F.concat(F.when(F.col("event_type") == "error", "Login failed for user ").otherwise("info "), F.col("event_id").cast("string"))
    return _finish_windows(t, lambda e: st.login_failure_alerts(e.select(F.col("ts").alias("log_date"), text.alias("log_text"))), "logins")


@query("t7_without_duplicates", "SELECT user_id AS instance_id, event_id AS record_id, ts AS collected_at, event_type FROM events")
def _(t):
    twice = _events(t).unionByName(_events(t))
    rows = timed(twice, "ts", "10 minutes").select(F.col("user_id").alias("instance_id"), F.col("event_id").alias("record_id"), F.col("ts").alias("collected_at"), "event_type")
    once = st.without_duplicates(rows, ["instance_id", "record_id"])
    return _finish(t, once.withColumn("collected_at", from_instant("collected_at")), "dedupe")


@query("t8_enrich", "SELECT s_suppkey AS user_id, event_id, ts, event_type, s_name AS name FROM events JOIN supplier ON s_suppkey = user_id UNION ALL SELECT user_id, event_id, ts, event_type, NULL FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)")
def _(t):
    names = t.supplier.select(F.col("s_suppkey").alias("user_id"), F.col("s_name").alias("name"))
    return _finish(t, st.enrich(_events(t).select("user_id", "event_id", "ts", "event_type"), names, ["user_id"]), "enrich")


_AS_OF = """
    SELECT s.*, c.state FROM bf_state_samples s ASOF LEFT JOIN bf_state_changes c ON s.instance_id = c.instance_id AND s.collected_at >= c.collected_at"""


@query("t9_state_as_of", _AS_OF)
def _(t):
    return state_as_of(t.state_samples, t.state_changes.drop("change_id"), ["instance_id"], "collected_at", ["state"], F.to_date("collected_at"))


@query("p53_state_by_intervals", _AS_OF)
def _(t):
    return state_by_intervals(t.state_samples, t.state_changes, ["instance_id"], "collected_at", ["state"], F.to_date("collected_at"))


@query("p53_jobs_during_blocking", """
    WITH e AS (SELECT user_id % 40 AS instance_id, ts, CASE WHEN ts < LAG(ts) OVER w + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id % 40 ORDER BY ts, event_id)),
    g AS (SELECT *, SUM(fresh) OVER (PARTITION BY instance_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS episode FROM e),
    b AS (SELECT instance_id, MIN(ts) AS blocked_from, MAX(ts) + INTERVAL 5 MINUTE AS blocked_until, COUNT(*) AS samples FROM g GROUP BY instance_id, episode),
    j AS (SELECT user_id % 40 AS instance_id, event_id AS run_id, ts AS started_at, ts + TO_SECONDS(CAST(ROUND(value * 100) AS BIGINT) * CASE WHEN event_id % 50 = 0 THEN 400 ELSE 1 END) AS ended_at FROM events WHERE event_type NOT IN ('click', 'view'))
    SELECT j.instance_id, run_id, started_at, ended_at, COUNT(*) AS episodes, CAST(SUM(samples) AS BIGINT) AS blocked_samples, MIN(blocked_from) AS first_blocked_from
    FROM j JOIN b ON j.instance_id = b.instance_id AND started_at < blocked_until AND blocked_from < ended_at GROUP BY ALL""")
def _(t):
    """Job runs that overlap blocking episodes of their instance, some of them very long."""
    events = t.events.withColumn("instance_id", F.col("user_id") % 40)
    watched = F.col("event_type").isin("click", "view")
    episodes = (st.episodes(events.where(watched).withColumn("ts", to_instant("ts")), "ts", ["instance_id"], "5 minutes", [F.count(F.lit(1)).alias("samples")])
                .withColumnsRenamed({"window_start": "blocked_from", "window_end": "blocked_until"}))
    seconds = _gauge() * F.when(F.col("event_id") % 50 == 0, 400).otherwise(1)
    runs = events.where(~watched).select("instance_id", F.col("event_id").alias("run_id"), F.col("ts").alias("started_at"), F.timestamp_add("SECOND", seconds, "ts").alias("ended_at"))
    met = overlap_join(runs, episodes, ["instance_id"], ("started_at", "ended_at"), ("blocked_from", "blocked_until"), prefix="")
    return met.groupBy("instance_id", "run_id", "started_at", "ended_at").agg(F.count(F.lit(1)).alias("episodes"), F.sum("samples").alias("blocked_samples"), F.min("blocked_from").alias("first_blocked_from"))


@query("t9_stream_state_as_of", _AS_OF)
def _(t):
    change = F.col("event_type").isin("error", "signup")
    rows = _events(t).select(F.col("user_id").alias("instance_id"), F.col("ts").alias("collected_at"), F.col("event_id").alias("sample_id"), _gauge().alias("gauge"), F.when(change, F.col("event_type")).alias("state"))
    folder = fresh_folder(t.spark, "state")
    st.stream_state_as_of(rows, folder, ["instance_id"], "collected_at", ["state"], F.col("state").isNotNull(), lateness="10 minutes", until=_over(t))
    return result(t.spark, folder)
