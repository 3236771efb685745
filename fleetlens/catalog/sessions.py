"""Session, blocking and lock queries over the given tables."""

from fleetlens.catalog.registry import FRAMES, query, rounded
from fleetlens.operators import activity as a, requests, sessions as s

R = rounded
AS_OF = "2001-12-01 00:00:00"

FRAMES.update(
    bf_session_samples="""
        SELECT user_id AS session_id, event_type AS request_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start_time, ts AS collected_at, event_id AS sample_id,
            CAST(EXTRACT(HOUR FROM ts)*3600 + EXTRACT(MINUTE FROM ts)*60 AS BIGINT) + CAST(ROUND(value*100) AS BIGINT) AS cpu, CAST(ROUND(value*10) AS BIGINT) AS reads
        FROM events""",
    bf_session_batches="""SELECT s_suppkey AS session_id, s_name AS text FROM supplier""",
    bf_owned_locks="""SELECT l.*, l_orderkey * 10 + l_linenumber AS lock_owner_address FROM (SELECT l_suppkey AS request_session_id,
            CASE l_linenumber % 4 WHEN 0 THEN 'OBJECT' WHEN 1 THEN 'KEY' WHEN 2 THEN 'PAGE' ELSE 'DATABASE' END AS resource_type,
            l_partkey AS resource_associated_entity_id, l_returnflag AS request_mode, l_suppkey % 5 AS resource_database_id, l_orderkey, l_linenumber FROM lineitem) l""",
    bf_lock_waits="""
        SELECT l_orderkey * 10 + l_linenumber AS resource_address, CAST(l_quantity AS BIGINT) AS wait_duration_ms, l_suppkey % 50 AS blocking_session_id
        FROM lineitem""",
    bf_hobts="""SELECT p_partkey AS hobt_id, p_partkey % 300 AS object_id, p_size % 3 AS index_id FROM part""",
    bf_part_objects="""SELECT p_partkey AS object_id, p_name AS name FROM part""",
    bf_part_indexes="""SELECT p_partkey AS object_id, 1 AS index_id, CONCAT('ix_', p_brand) AS name FROM part""",
    bf_five_databases="""SELECT r_regionkey AS database_id, r_name AS name FROM region""",
    bf_handle_sessions="""SELECT s_suppkey + 1 AS session_id, s_name AS login_name, s_suppkey % 500 AS plan_handle FROM supplier""",
    bf_space_usage="""
        SELECT o_custkey % 200 AS session_id, o_custkey % 7 AS internal_objects_alloc_page_count, o_orderkey % 5 AS user_objects_alloc_page_count,
            o_custkey % 3 AS internal_objects_dealloc_page_count, o_orderkey % 2 AS user_objects_dealloc_page_count FROM orders""",
    bf_session_transactions="""SELECT o_orderkey AS transaction_id, o_custkey AS session_id FROM orders WHERE o_orderstatus <> 'P'""",
    bf_snapshot_transactions="""SELECT o_orderkey AS transaction_id, o_custkey AS session_id, CAST(ROUND(o_totalprice) AS BIGINT) AS elapsed_time_seconds FROM orders""",
    bf_program_sessions="""SELECT c_custkey AS session_id, c_mktsegment AS program_name, c_custkey % 4 AS open_tran_count, 'running' AS status FROM customer WHERE c_acctbal > 0""",
    bf_deadlock_counters="""SELECT 'Number of Deadlocks/sec   ' AS counter_name, '_Total' AS instance_name, COUNT(*) AS cntr_value FROM events WHERE event_type = 'error'""",
    bf_start_times="""SELECT 'tempdb' AS name, MIN(o_orderdate) AS create_date FROM orders""",
    bf_memory_grants="""
        SELECT user_id AS session_id, event_id AS request_id, CAST(ROUND(value * 100) AS BIGINT) * 3 AS requested_memory_kb, CAST(ROUND(value * 100) AS BIGINT) * 2 AS granted_memory_kb, CAST(ROUND(value * 100) AS BIGINT) AS used_memory_kb,
            CAST(ROUND(value * 100) AS BIGINT) + event_id % 90 AS max_used_memory_kb, event_id % 700 AS wait_time_ms FROM events""",
    bf_trace_events="""
        SELECT o_orderkey AS trace_id, o_custkey AS object_id, o_orderkey % 3 AS database_id, 45 + o_orderkey % 2 AS event_class, o_custkey % 2 AS event_subclass, o_orderpriority AS login_name
        FROM orders""",
    bf_temp_objects="""SELECT c_custkey AS object_id, CASE WHEN c_custkey % 3 = 0 THEN CONCAT('#', c_name) ELSE c_name END AS name, TIMESTAMP '2001-01-01 00:00:00' AS create_date FROM customer""",
)


@query("s1_active_sessions", """
    SELECT * FROM bf_sessions WHERE login_name LIKE 'Supplier%' AND NOT login_name LIKE '%7' AND (status <> 'sleeping' OR open_tran_count > 0) AND session_id <> 20""")
def _(t):
    return s.active_sessions(t.sessions, include=("login", "Supplier%"), exclude=("login", "%7"), own_session=20)


@query("s2_session_delta", """
    WITH p AS (SELECT *, LAG(cpu) OVER w AS pc, LAG(reads) OVER w AS pr FROM bf_session_samples
        WINDOW w AS (PARTITION BY session_id, request_id, start_time ORDER BY collected_at, sample_id))
    SELECT * EXCLUDE (pc, pr), CASE WHEN cpu >= pc THEN cpu - pc END AS cpu_delta, CASE WHEN reads >= pr THEN reads - pr END AS reads_delta FROM p""")
def _(t):
    return s.session_delta(t.session_samples, ["cpu", "reads"], ("collected_at", "sample_id"))


@query("s3_blocking_tree", """
    WITH RECURSIVE b AS (SELECT session_id, 0 AS level, LPAD(CAST(session_id AS VARCHAR), 10, '0') AS path FROM bf_sessions r
            WHERE blocking_session_id = 0 AND EXISTS (SELECT 1 FROM bf_sessions x WHERE x.blocking_session_id = r.session_id)
        UNION ALL SELECT c.session_id, b.level + 1, b.path || LPAD(CAST(c.session_id AS VARCHAR), 10, '0') FROM bf_sessions c JOIN b ON c.blocking_session_id = b.session_id)
    SELECT session_id, level, path, '    ' || REPEAT('|         ', level) || CASE level WHEN 0 THEN 'HEAD -  ' ELSE '|------  ' END || CAST(session_id AS VARCHAR) AS blocking_tree FROM b""")
def _(t):
    return s.blocking_tree(t.sessions)


@query("s4_blocked_session_count", """
    WITH RECURSIVE b AS (SELECT session_id AS top, session_id FROM bf_sessions
        UNION ALL SELECT b.top, c.session_id FROM bf_sessions c JOIN b ON c.blocking_session_id = b.session_id)
    SELECT top AS session_id, COUNT(*) - 1 AS blocked_session_count FROM b GROUP BY top""")
def _(t):
    return s.blocked_session_count(t.sessions)


@query("s5_blocking_pairs", """
    SELECT resource_type AS lock_type, resource_database_id AS database_id, resource_associated_entity_id AS blocked_object, request_mode AS lock_requested,
        request_session_id AS waiter_session_id, wait_duration_ms AS wait_ms, a.text AS waiter_batch, w.blocking_session_id AS blocker_session_id, b.text AS blocker_batch
    FROM bf_owned_locks l JOIN bf_lock_waits w ON l.lock_owner_address = w.resource_address
    LEFT JOIN bf_session_batches a ON a.session_id = l.request_session_id LEFT JOIN bf_session_batches b ON b.session_id = w.blocking_session_id""")
def _(t):
    return s.blocking_pairs(t.owned_locks, t.lock_waits, t.session_batches)


@query("s6_locks_by_object", """
    WITH l AS (SELECT l.*, h.index_id, CASE WHEN resource_type = 'OBJECT' THEN resource_associated_entity_id ELSE h.object_id END AS object_id
        FROM bf_locks l LEFT JOIN bf_hobts h ON l.resource_type IN ('KEY', 'PAGE', 'RID') AND h.hobt_id = l.resource_associated_entity_id)
    SELECT l.*, i.name AS index_name, CASE WHEN resource_type = 'DATABASE' THEN resource_type ELSE o.name END AS requested_object_name
    FROM l LEFT JOIN bf_part_objects o ON l.object_id = o.object_id LEFT JOIN bf_part_indexes i ON l.object_id = i.object_id AND l.index_id = i.index_id""")
def _(t):
    return s.locks_by_object(t.locks, t.hobts, t.part_indexes, t.part_objects)


@query("s7_locks_document", """
    WITH p AS (SELECT request_session_id, resource_database_id, resource_associated_entity_id, resource_type, request_mode, request_status, COUNT(*) AS request_count FROM bf_locks GROUP BY ALL)
    SELECT request_session_id, resource_database_id, resource_associated_entity_id,
        CAST(TO_JSON(LIST_SORT(LIST({'resource_type': resource_type, 'request_mode': request_mode, 'request_status': request_status, 'request_count': request_count}))) AS VARCHAR) AS locks FROM p GROUP BY 1, 2, 3""")
def _(t):
    return s.locks_document(t.locks)


@query("s8_select_output_columns", """
    SELECT session_id, blocking_session_id, login_name, status, database_id, open_tran_count, transaction_isolation_level FROM bf_sessions""")
def _(t):
    return s.select_output_columns(t.sessions, "[session_id][block%][%name][%]", "[session_id] DESC")


@query("s9_format_elapsed", """
    SELECT *, CASE WHEN d < 100 THEN LPAD(CAST(d AS VARCHAR), 2, '0') ELSE CAST(d AS VARCHAR) END || ' ' || LPAD(CAST(h AS VARCHAR), 2, '0') || ':' || LPAD(CAST(m AS VARCHAR), 2, '0') || ':' ||
        LPAD(CAST(s AS VARCHAR), 2, '0') || '.' || LPAD(CAST(total_elapsed_time % 1000 AS VARCHAR), 3, '0') AS elapsed_text
    FROM (SELECT *, total_elapsed_time // 86400000 AS d, total_elapsed_time // 3600000 % 24 AS h, total_elapsed_time // 60000 % 60 AS m, total_elapsed_time // 1000 % 60 AS s FROM bf_requests)""".replace(
        "SELECT *, CASE", "SELECT * EXCLUDE (d, h, m, s), CASE", 1))
def _(t):
    return requests.elapsed_texts(t.requests)


@query("s10_transaction_log_writes", """
    WITH p AS (SELECT session_id, t.database_id, r.name, COUNT(*) AS w, SUM(log_bytes_used) AS b, MIN(begin_time) AS st
        FROM bf_transactions t LEFT JOIN bf_five_databases r ON t.database_id = r.database_id GROUP BY ALL)
    SELECT session_id, MIN(st) AS tran_start_time, STRING_AGG(name || ': ' || CAST(w AS VARCHAR) || ' (' || CAST(CAST(b // 1024 AS BIGINT) AS VARCHAR) || ' kB)', ', ' ORDER BY database_id) AS tran_log_writes,
        'OFF' AS implicit_tran FROM p GROUP BY session_id""")
def _(t):
    return s.transaction_log_writes(t.transactions, t.five_databases)


@query("s11_average_elapsed", """
    SELECT s.*, CAST(q.total_elapsed_time // q.execution_count AS BIGINT) AS avg_elapsed_time FROM bf_handle_sessions s LEFT JOIN bf_query_stats q ON s.plan_handle = q.plan_handle""")
def _(t):
    return s.average_elapsed(t.handle_sessions, t.query_stats)


@query("s12_tempdb_by_session", f"""
    WITH p AS (SELECT session_id, SUM(internal_objects_alloc_page_count) AS i, SUM(user_objects_alloc_page_count) AS u FROM bf_space_usage
        WHERE internal_objects_alloc_page_count + user_objects_alloc_page_count > 0 GROUP BY 1)
    SELECT p.session_id, login_name, s.database_id, d.name AS database_name, {R('(i * 8)', '1024', 2)} AS internal_objects_mb, {R('(u * 8)', '1024', 2)} AS user_objects_mb
    FROM p LEFT JOIN bf_sessions s ON p.session_id = s.session_id LEFT JOIN bf_five_databases d ON s.database_id = d.database_id""")
def _(t):
    return s.tempdb_by_session(t.space_usage, t.sessions, t.five_databases)


@query("s12_tempdb_outstanding", """
    WITH p AS (SELECT session_id, SUM(internal_objects_alloc_page_count - internal_objects_dealloc_page_count) AS i, SUM(user_objects_alloc_page_count - user_objects_dealloc_page_count) AS u
        FROM bf_space_usage WHERE internal_objects_alloc_page_count + user_objects_alloc_page_count > 0 GROUP BY 1)
    SELECT p.session_id, login_name, s.database_id, d.name AS database_name, CAST(i AS BIGINT) AS outstanding_internal_objects_pages, CAST(u AS BIGINT) AS outstanding_user_objects_pages
    FROM p LEFT JOIN bf_sessions s ON p.session_id = s.session_id LEFT JOIN bf_five_databases d ON s.database_id = d.database_id""")
def _(t):
    return s.tempdb_by_session(t.space_usage, t.sessions, t.five_databases, outstanding=True)


def _case(column, texts):
    return f"CASE {column} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in texts.items()) + " END"


@query("s13_open_transactions", f"""
    SELECT s.session_id, t.transaction_id, t.database_id, CASE WHEN d.name IS NULL AND t.database_id = 2 THEN 'TEMPDB' ELSE d.name END AS database_name,
        {R('log_bytes_used', '1024', 2)} AS log_used_kb, begin_time, {_case('database_transaction_type', s.TRANSACTION_TYPES)} AS transaction_type,
        {_case('database_transaction_state', s.TRANSACTION_STATES)} AS transaction_state
    FROM bf_transactions t JOIN bf_session_transactions s ON t.transaction_id = s.transaction_id LEFT JOIN (SELECT * FROM bf_five_databases WHERE database_id <> 2) d ON t.database_id = d.database_id""")
def _(t):
    return s.open_transactions(t.transactions.drop("session_id"), t.session_transactions, t.five_databases.where("database_id <> 2"))


@query("s14_longest_snapshot_transactions", """
    SELECT t.*, program_name, open_tran_count, status FROM bf_snapshot_transactions t JOIN bf_program_sessions s ON t.session_id = s.session_id
    ORDER BY elapsed_time_seconds DESC, transaction_id LIMIT 5""")
def _(t):
    return s.longest_snapshot_transactions(t.snapshot_transactions, t.program_sessions)


@query("s15_deadlocks_per_day", f"""
    SELECT CAST(cntr_value // NULLIF(DATEDIFF('day', create_date, TIMESTAMP '{AS_OF}'), 0) AS BIGINT) AS average_per_day,
        CAST(cntr_value AS VARCHAR) || ' deadlocks since the start' AS details, create_date AS startup_time FROM bf_deadlock_counters, bf_start_times""")
def _(t):
    return s.deadlocks_per_day(t.deadlock_counters, t.start_times, AS_OF)


@query("s17_isolation_level_text", f"SELECT *, {_case('transaction_isolation_level', s.ISOLATION_LEVELS)} AS isolation_level FROM bf_sessions")
def _(t):
    return s.isolation_level_text(t.sessions)


@query("s18_temp_object_owner", """
    SELECT e.*, o.name, o.create_date FROM bf_trace_events e JOIN bf_temp_objects o ON e.object_id = o.object_id
    WHERE database_id = 2 AND event_class = 46 AND event_subclass = 1 AND name LIKE '#%'""")
def _(t):
    return s.temp_object_owner(t.trace_events, t.temp_objects)


@query("s19_resolve_wait_resource", """
    SELECT hobt_id, h.object_id, h.index_id, o.name AS table_name, i.name AS index_name FROM bf_hobts h JOIN bf_part_objects o ON h.object_id = o.object_id
    JOIN bf_part_indexes i ON h.object_id = i.object_id AND h.index_id = i.index_id""")
def _(t):
    return s.resolve_wait_resource(t.hobts, t.part_objects, t.part_indexes)


@query("s20_activity_block_leaders", """
    WITH RECURSIVE b AS (SELECT session_id AS top, session_id FROM bf_sessions
        UNION ALL SELECT b.top, c.session_id FROM bf_sessions c JOIN b ON c.blocking_session_id = b.session_id),
    n AS (SELECT top, COUNT(*) - 1 AS blocked_session_count FROM b GROUP BY top)
    SELECT s.*, blocked_session_count FROM bf_sessions s LEFT JOIN n ON s.session_id = n.top WHERE status <> 'sleeping' OR open_tran_count > 0""")
def _(t):
    return s.activity_recipe("block_leaders", t.sessions, s.blocked_session_count(t.sessions))


@query("s20_activity_tempdb", f"""
    WITH p AS (SELECT session_id, SUM(internal_objects_alloc_page_count) AS i, SUM(user_objects_alloc_page_count) AS u FROM bf_space_usage
        WHERE internal_objects_alloc_page_count + user_objects_alloc_page_count > 0 GROUP BY 1)
    SELECT s.*, CASE WHEN i IS NOT NULL THEN d.name END AS database_name, {R('(i * 8)', '1024', 2)} AS internal_objects_mb, {R('(u * 8)', '1024', 2)} AS user_objects_mb
    FROM bf_sessions s LEFT JOIN p ON p.session_id = s.session_id LEFT JOIN bf_five_databases d ON s.database_id = d.database_id WHERE status <> 'sleeping' OR open_tran_count > 0""")
def _(t):
    return s.activity_recipe("tempdb", t.sessions, s.tempdb_by_session(t.space_usage, t.sessions, t.five_databases))


_ISOLATION = "CASE transaction_isolation_level WHEN 0 THEN 'Unspecified' WHEN 1 THEN 'READ UNCOMMITTED' WHEN 2 THEN 'READ COMMITTED' WHEN 3 THEN 'REPEATABLE READ' WHEN 4 THEN 'SERIALIZABLE' WHEN 5 THEN 'SNAPSHOT' END"


def _clock(ms):
    two = lambda x: f"CASE WHEN {x} < 100 THEN LPAD(CAST({x} AS VARCHAR), 2, '0') ELSE CAST({x} AS VARCHAR) END"
    return (f"{two(f'({ms} // 86400000)')} || ' ' || LPAD(CAST({ms} // 3600000 % 24 AS VARCHAR), 2, '0') || ':' || LPAD(CAST({ms} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || "
            f"LPAD(CAST({ms} // 1000 % 60 AS VARCHAR), 2, '0') || '.' || LPAD(CAST({ms} % 1000 AS VARCHAR), 3, '0')")


def _activity(columns, tran=False, rows=""):
    """The SQL of activity rows: the parts of every detail, of which `columns` chooses."""
    shown = f"COALESCE(total_elapsed_time, CAST(FLOOR((EPOCH_US(TIMESTAMP '{AS_OF}') - EPOCH_US(tran_start_time)) / 1000) AS BIGINT))" if tran else "total_elapsed_time"
    return f"""
    WITH RECURSIVE w AS (SELECT session_id, wait_type, '(' || CAST(COUNT(*) AS VARCHAR) || 'x: ' || CASE COUNT(*) WHEN 1 THEN CAST(MIN(wait_duration_ms) AS VARCHAR) WHEN 2 THEN CAST(MIN(wait_duration_ms) AS VARCHAR) || '/' || CAST(MAX(wait_duration_ms) AS VARCHAR)
            ELSE CAST(MIN(wait_duration_ms) AS VARCHAR) || '/' || CAST(SUM(wait_duration_ms) // COUNT(*) AS VARCHAR) || '/' || CAST(MAX(wait_duration_ms) AS VARCHAR) END || 'ms)' || wait_type AS info FROM bf_waiting_tasks GROUP BY 1, 2),
    waits AS (SELECT session_id, STRING_AGG(info, ', ' ORDER BY info) AS wait_info FROM w GROUP BY 1),
    tl AS (SELECT session_id, t.database_id, r.name, COUNT(*) AS n, SUM(log_bytes_used) AS b, MIN(begin_time) AS st FROM bf_transactions t LEFT JOIN bf_five_databases r ON t.database_id = r.database_id GROUP BY ALL),
    trans AS (SELECT session_id, MIN(st) AS tran_start_time, STRING_AGG(COALESCE(name, '(null)') || ': ' || CAST(n AS VARCHAR) || ' (' || CAST(CAST(b // 1024 AS BIGINT) AS VARCHAR) || ' kB)', ', ' ORDER BY database_id) AS tran_log_writes, 'OFF' AS implicit_tran FROM tl GROUP BY 1),
    temp AS (SELECT session_id, CAST(SUM(internal_objects_alloc_page_count + user_objects_alloc_page_count) AS BIGINT) AS tempdb_allocations,
        CAST(SUM(internal_objects_alloc_page_count + user_objects_alloc_page_count - internal_objects_dealloc_page_count - user_objects_dealloc_page_count) AS BIGINT) AS tempdb_current FROM bf_space_usage GROUP BY 1),
    mem AS (SELECT session_id, request_id, CAST(SUM(used_memory_kb) // 8 AS BIGINT) AS used_memory, CAST(SUM(max_used_memory_kb) // 8 AS BIGINT) AS max_used_memory, CAST(SUM(requested_memory_kb) // 8 AS BIGINT) AS requested_memory,
        CAST(SUM(granted_memory_kb) // 8 AS BIGINT) AS granted_memory, MAX(wait_time_ms) AS grant_wait_ms FROM bf_memory_grants GROUP BY 1, 2),
    dp AS (SELECT *, LAG(cpu) OVER v AS pc, LAG(reads) OVER v AS pr FROM bf_session_samples WINDOW v AS (PARTITION BY session_id, request_id, start_time ORDER BY collected_at, sample_id)),
    deltas AS (SELECT session_id, CASE WHEN cpu >= pc THEN cpu - pc END AS cpu_delta, CASE WHEN reads >= pr THEN reads - pr END AS reads_delta FROM dp QUALIFY ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY collected_at DESC, sample_id) = 1),
    b AS (SELECT session_id AS top, session_id FROM bf_sessions UNION ALL SELECT b.top, c.session_id FROM bf_sessions c JOIN b ON c.blocking_session_id = b.session_id),
    led AS (SELECT top AS session_id, COUNT(*) - 1 AS blocked_session_count FROM b GROUP BY 1),
    q AS (SELECT session_id AS sid, MIN(text) AS sql_text FROM bf_session_batches GROUP BY 1)
    SELECT {_clock(shown)} AS dd_hh_mm_ss_mss, s.session_id, r.request_id, blocking_session_id, login_name, status, open_tran_count, command, start_time, cpu_time AS cpu, {_ISOLATION} AS isolation_level, d.name AS database_name, {columns}
    FROM bf_sessions s LEFT JOIN bf_requests r ON r.session_id = s.session_id LEFT JOIN bf_five_databases d ON d.database_id = s.database_id LEFT JOIN waits ON waits.session_id = s.session_id LEFT JOIN trans ON trans.session_id = s.session_id
        LEFT JOIN temp ON temp.session_id = s.session_id LEFT JOIN mem ON mem.session_id = s.session_id AND mem.request_id = r.request_id LEFT JOIN deltas ON deltas.session_id = s.session_id LEFT JOIN led ON led.session_id = s.session_id LEFT JOIN q ON q.sid = s.session_id
    WHERE status <> 'sleeping' OR open_tran_count > 0"""


_TRAN, _MEM, _TEMP = "tran_start_time, tran_log_writes, implicit_tran", "used_memory, max_used_memory, requested_memory, granted_memory, grant_wait_ms", "tempdb_allocations, tempdb_current"
_ALL = f"sql_text, wait_info, {_TRAN}, {_TEMP}, {_MEM}, cpu_delta, reads_delta, blocked_session_count"


def _details(t):
    return {"texts": t.session_batches, "waiting_tasks": t.waiting_tasks, "transactions": t.transactions, "grants": t.memory_grants, "space_usage": t.space_usage,
            "samples": t.session_samples, "sample_order": ("collected_at", "sample_id"), "blocking": True}


@query("s1_activity_row", _activity(_ALL, tran=True))
def _(t):
    return a.activity_rows(t.sessions, t.requests, AS_OF, t.five_databases, **_details(t))


@query("s20_activity_delta", _activity("sql_text, cpu_delta, reads_delta"))
def _(t):
    return a.activity_preset("delta", t.sessions, t.requests, AS_OF, t.five_databases, **_details(t))


@query("s20_activity_transactions", _activity(f"sql_text, {_TRAN}", tran=True))
def _(t):
    return a.activity_preset("transactions", t.sessions, t.requests, AS_OF, t.five_databases, **_details(t))


@query("s20_activity_memory", _activity(f"sql_text, {_MEM}"))
def _(t):
    return a.activity_preset("memory", t.sessions, t.requests, AS_OF, t.five_databases, **_details(t))


@query("s20_activity_extended", _activity(f"sql_text, wait_info, {_TRAN}, {_TEMP}, {_MEM}, blocked_session_count", tran=True))
def _(t):
    return a.activity_preset("extended", t.sessions, t.requests, AS_OF, t.five_databases, **_details(t))


@query("s20_activity_tempdb_current", _activity(f"sql_text, wait_info, {_TEMP}"))
def _(t):
    return a.activity_preset("tempdb", t.sessions, t.requests, AS_OF, t.five_databases, **_details(t))


@query("s20_activity_blocking", _activity("sql_text, blocked_session_count"))
def _(t):
    return a.activity_preset("block_leaders", t.sessions, t.requests, AS_OF, t.five_databases, **_details(t))
