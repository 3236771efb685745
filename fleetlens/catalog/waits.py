"""Wait queries over the given tables."""

from pyspark.sql import functions as F

from fleetlens.catalog.registry import FRAMES, query, rounded
from fleetlens.functions.wait_lists import EDITIONS
from fleetlens.operators import waits

FRAMES.update(
    bf_tables="""SELECT s_suppkey AS object_id, s_name AS name FROM supplier""",
    bf_table_indexes="""
        SELECT DISTINCT l_suppkey AS object_id, l_linenumber AS index_id, CONCAT('ix_', CAST(l_linenumber AS VARCHAR(10))) AS name,
            CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END AS type, l_linenumber = 2 AS is_unique,
            l_linenumber = 1 AS is_primary_key, l_linenumber = 7 AS is_disabled
        FROM lineitem""",
    bf_session_waits="""
        SELECT session_id, wait_type, wait_duration_ms AS wait_time_ms FROM bf_waiting_tasks""",
    bf_waits_snapshots="""
        SELECT instance_id, metric AS wait_type, collected_at, event_id, counter_value AS wait_time_ms FROM bf_snapshots""",
)


@query("w1_wait_pareto", f"""
    WITH w AS (SELECT bf_waits.*, wait_time_ms - signal_wait_time_ms AS res,
            ROW_NUMBER() OVER (ORDER BY wait_time_ms DESC, wait_type) AS rank,
            SUM(wait_time_ms) OVER () AS total
        FROM bf_waits WHERE wait_type NOT IN (SELECT wait_type FROM bf_benign) AND waiting_tasks_count > 0)
    SELECT a.wait_type, a.rank, {rounded('a.wait_time_ms', 'a.total', 2, 100)} AS wait_pct,
        {rounded('a.wait_time_ms', 'a.waiting_tasks_count * 1000', 4)} AS avg_wait_s,
        {rounded('a.res', 'a.waiting_tasks_count * 1000', 4)} AS avg_resource_s,
        {rounded('a.signal_wait_time_ms', 'a.waiting_tasks_count * 1000', 4)} AS avg_signal_s,
        {rounded('a.wait_time_ms', '1000', 2)} AS wait_s, {rounded('a.res', '1000', 2)} AS resource_s,
        {rounded('a.signal_wait_time_ms', '1000', 2)} AS signal_s, a.waiting_tasks_count AS wait_count
    FROM w a JOIN (SELECT x.rank, SUM(y.wait_time_ms) AS upto FROM w x JOIN w y ON y.rank <= x.rank GROUP BY x.rank) b ON a.rank = b.rank
    WHERE (b.upto - a.wait_time_ms) * 100 < a.total * 95""")
def _(t):
    return waits.wait_pareto(t.waits, 95, t.benign)


_LISTS = "(VALUES " + ", ".join(f"('{w}', '{e}')" for e, ws in EDITIONS.items() for w in ws) + ") AS v(wait_type, edition)"


@query("w2_benign_waits", f"""
    SELECT v.wait_type, edition, landed_count FROM {_LISTS} LEFT JOIN (SELECT wait_type, CAST(SUM(waiting_tasks_count) AS BIGINT) AS landed_count FROM bf_waits GROUP BY 1) w ON w.wait_type = v.wait_type""")
def _(t):
    # the lists as data, next to how often the landed waits contain each type
    lists = None
    for edition in EDITIONS:
        one = waits.benign_waits(t.spark, edition).withColumn("edition", F.lit(edition))
        lists = one if lists is None else lists.unionByName(one)
    landed = t.waits.groupBy("wait_type").agg(F.sum("waiting_tasks_count").alias("landed_count"))
    return lists.join(landed, "wait_type", "left")


@query("w3_wait_share_top", f"""
    WITH w AS (SELECT *, SUM(wait_time_ms) OVER () AS tw, SUM(signal_wait_time_ms) OVER () AS ts FROM bf_waits WHERE wait_time_ms > 0)
    SELECT wait_type, CAST(wait_time_ms AS BIGINT) AS wait_time_ms, CAST(signal_wait_time_ms AS BIGINT) AS signal_wait_time_ms,
        CAST(wait_time_ms - signal_wait_time_ms AS BIGINT) AS resource_wait_time_ms,
        {rounded('wait_time_ms', 'tw', 4, 100)} AS pct_total_waits, {rounded('signal_wait_time_ms', 'ts', 4, 100)} AS pct_total_signal_waits,
        {rounded('(wait_time_ms - signal_wait_time_ms)', 'tw', 4, 100)} AS pct_total_resource_waits
    FROM w ORDER BY w.wait_time_ms DESC, wait_type LIMIT 10""")
def _(t):
    return waits.wait_share_top(t.waits, 10)


@query("w4_session_top_waits", """
    WITH s AS (SELECT session_id, wait_type, SUM(wait_time_ms) AS ms FROM bf_session_waits GROUP BY 1, 2 HAVING SUM(wait_time_ms) > 500),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY ms DESC, wait_type) AS rn FROM s)
    SELECT session_id, STRING_AGG(wait_type || ' (' || CAST(CAST(ms AS BIGINT) AS VARCHAR) || ' ms)', ', ' ORDER BY rn) AS top_waits
    FROM r WHERE rn <= 5 GROUP BY session_id""")
def _(t):
    return waits.session_top_waits(t.session_waits)


@query("w5_wait_info", """
    SELECT session_id, wait_type, '(' || CAST(COUNT(*) AS VARCHAR) || 'x: ' || CASE COUNT(*)
        WHEN 1 THEN CAST(MIN(wait_duration_ms) AS VARCHAR)
        WHEN 2 THEN CAST(MIN(wait_duration_ms) AS VARCHAR) || '/' || CAST(MAX(wait_duration_ms) AS VARCHAR)
        ELSE CAST(MIN(wait_duration_ms) AS VARCHAR) || '/' || CAST(SUM(wait_duration_ms) // COUNT(*) AS VARCHAR) || '/' || CAST(MAX(wait_duration_ms) AS VARCHAR)
        END || 'ms)' || wait_type AS wait_info
    FROM bf_waiting_tasks GROUP BY session_id, wait_type""")
def _(t):
    return waits.wait_info(t.waiting_tasks)


@query("w6_lock_waits", """
    SELECT u.object_id, u.index_id, t.name AS table_name, i.name AS index_name,
        CAST(SUM(row_lock_wait_in_ms) AS BIGINT) AS total_row_lock_wait_in_ms, CAST(SUM(page_lock_wait_in_ms) AS BIGINT) AS total_page_lock_wait_in_ms,
        CAST(SUM(row_lock_wait_in_ms + page_lock_wait_in_ms) AS BIGINT) AS total_lock_wait_in_ms
    FROM bf_index_usage u JOIN bf_tables t ON u.object_id = t.object_id
    JOIN bf_table_indexes i ON u.object_id = i.object_id AND u.index_id = i.index_id
    GROUP BY ALL HAVING SUM(row_lock_wait_in_ms + page_lock_wait_in_ms) > 0""")
def _(t):
    return waits.lock_waits(t.index_usage, t.tables, t.table_indexes)


@query("w7_wait_delta", """
    WITH d AS (SELECT *, LAG(wait_time_ms) OVER (PARTITION BY instance_id, wait_type ORDER BY collected_at, event_id) AS prev_wait_time_ms
        FROM bf_waits_snapshots)
    SELECT *, CASE WHEN wait_time_ms >= prev_wait_time_ms THEN wait_time_ms - prev_wait_time_ms END AS wait_time_ms_delta FROM d""")
def _(t):
    return waits.wait_delta(t.waits_snapshots, ("collected_at", "event_id"))
