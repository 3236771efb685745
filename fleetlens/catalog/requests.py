"""Query-statistics and request queries over the given tables."""

from fleetlens.catalog.registry import FRAMES, query, rounded
from fleetlens.operators import requests as q

R = rounded
AS_OF, EVENTS_AS_OF = "2001-12-01 00:00:00", "2024-01-31 00:00:00"

FRAMES.update(
    bf_plans="""
        SELECT p_partkey AS plan_handle, CONCAT(
            '<ShowPlanXML xmlns="http://schemas.microsoft.com/sqlserver/2004/07/showplan"><BatchSequence><Batch><Statements><StmtSimple StatementText="',
            p_name, ' ', CAST(p_partkey AS VARCHAR(20)), '" StatementSubTreeCost="', CAST(p_size AS VARCHAR(10)), '.5"><QueryPlan>',
            CASE WHEN p_size % 3 = 0 THEN '<MissingIndexes><MissingIndexGroup Impact="50"/></MissingIndexes>' ELSE '' END,
            '<RelOp PhysicalOp="', CASE p_size % 4 WHEN 0 THEN 'Parallelism' WHEN 1 THEN 'Table Scan' WHEN 2 THEN 'Index Scan' ELSE 'Sort' END, '"><',
            CASE WHEN p_size % 4 = 1 THEN 'TableScan' ELSE 'IndexScan' END, CASE WHEN p_size % 5 = 0 THEN ' ForcedIndex="1"' ELSE '' END,
            '><Object Schema="[dbo]" Table="[', CASE WHEN p_size % 7 = 0 THEN '@' ELSE '' END, p_type, ']" Index="[IX_', p_brand, ']"/><Predicate><ScalarOperator ScalarString="f(',
            p_brand, ')"><Convert DataType="', CASE WHEN p_size % 2 = 0 THEN 'nvarchar' ELSE 'int' END, '" Length="', CAST(p_size AS VARCHAR(10)), '" Implicit="',
            CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END, '"><ScalarOperator><Identifier><ColumnReference Database="[db]" Schema="[dbo]" Table="[', p_type, ']" Column="', p_brand,
            '"/></Identifier></ScalarOperator></Convert></ScalarOperator></Predicate></', CASE WHEN p_size % 4 = 1 THEN 'TableScan' ELSE 'IndexScan' END,
            '></RelOp></QueryPlan></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>') AS query_plan
        FROM part""",
    bf_proc_stats="""SELECT plan_handle AS object_id, creation_time AS cached_time, s.* FROM bf_query_stats s""",
    bf_procedures="""SELECT p_partkey AS object_id, p_name AS name FROM part WHERE p_size <> 13""",
    bf_plan_attributes="""SELECT p_partkey AS plan_handle, p_size % 9 AS database_id FROM part""",
    bf_statement_texts="""SELECT plan_handle, text, 2 AS statement_start_offset, -1 AS statement_end_offset FROM bf_query_texts""",
    bf_hinted_texts="""SELECT p_partkey AS plan_handle, CONCAT(p_name, CASE WHEN p_size % 2 = 0 THEN ' with (index(ix))' ELSE '' END) AS text FROM part""",
    bf_adhoc_setting="""SELECT 'Optimize for ad hoc workloads' AS name, COUNT(*) % 2 AS value FROM customer WHERE c_nationkey >= 0""",
    bf_missing_rows="""SELECT p_type AS statement, p_size % 3 AS index_id, p_partkey AS row_count FROM part""",
    bf_function_stats="""
        SELECT plan_handle AS object_id, CASE WHEN database_id < 3 THEN 'SQL_SCALAR_FUNCTION' ELSE 'SQL_TABLE_FUNCTION' END AS type_desc,
            creation_time AS cached_time, s.* FROM bf_query_stats s""",
    bf_modules="""SELECT p_partkey AS object_id, p_name AS name, p_size % 2 = 0 AS is_inlineable, p_size % 3 AS inline_type FROM part""",
    bf_store_plans="""
        SELECT o_custkey AS query_id, o_orderkey AS plan_id, o_orderstatus = 'F' AS is_forced_plan,
            CONCAT('<Object Index="[IX_', o_orderpriority, ']"/>') AS query_plan FROM orders""",
    bf_profiles="""
        SELECT l_suppkey AS session_id, l_orderkey * 10 + l_linenumber AS task_id, l_linenumber AS node_id, CAST(l_quantity AS BIGINT) AS row_count,
            CAST(l_quantity AS BIGINT) + l_linenumber AS estimate_row_count, l_orderkey AS first_active_time, l_orderkey + l_partkey AS last_active_time,
            CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS close_time, 1 AS first_row_time,
            CASE l_linenumber WHEN 1 THEN 'Table Scan' WHEN 2 THEN 'Sort' WHEN 3 THEN 'Index Scan' WHEN 4 THEN 'Nested Loops' ELSE 'Index Insert' END AS physical_operator_name
        FROM lineitem""",
    bf_user_sessions="""
        SELECT user_id AS session_id, CONCAT('login_', CAST(user_id % 7 AS VARCHAR(10))) AS login_name, CONCAT('host_', CAST(user_id % 11 AS VARCHAR(10))) AS host_name,
            CONCAT('app_', CAST(user_id % 3 AS VARCHAR(10))) AS program_name, MIN(ts) AS login_time, user_id % 5 AS database_id
        FROM events GROUP BY user_id""",
    bf_connections="""SELECT user_id AS session_id, CONCAT('10.0.0.', event_type) AS client_net_address FROM events""",
    bf_input_buffers="""SELECT user_id AS session_id, MAX(event_type) AS event_info FROM events GROUP BY user_id""",
    bf_tasks="""
        SELECT l_suppkey AS session_id, l_orderkey * 10 + l_linenumber AS task_id, CASE WHEN l_linenumber > 1 THEN l_orderkey * 10 + 1 END AS parent_task_id,
            l_linestatus AS task_state FROM lineitem""",
    bf_current_waits="""SELECT session_id, task_id, wait_type, wait_duration_ms FROM bf_waiting_tasks""",
)


def _leader(by, order, plans=False):
    flag = ", CAST(p.query_plan LIKE '%<MissingIndexes>%' AS INTEGER) AS has_missing_index" if plans else ""
    join = " LEFT JOIN bf_plans p ON p.plan_handle = s.plan_handle" if plans else ""
    check = f"""
        SELECT s.plan_handle, s.database_id, LEFT(t.text, 255) AS short_query_text, execution_count, CAST(total_worker_time AS BIGINT) AS total_worker_time,
            CAST(total_worker_time // execution_count AS BIGINT) AS avg_worker_time, min_worker_time, max_worker_time, CAST(total_elapsed_time AS BIGINT) AS total_elapsed_time,
            CAST(total_elapsed_time // execution_count AS BIGINT) AS avg_elapsed_time, CAST(total_logical_reads AS BIGINT) AS total_logical_reads,
            CAST(total_logical_reads // execution_count AS BIGINT) AS avg_logical_reads, CAST(total_logical_writes AS BIGINT) AS total_logical_writes,
            CAST(total_logical_writes // execution_count AS BIGINT) AS avg_logical_writes, creation_time{flag}
        FROM bf_query_stats s LEFT JOIN bf_query_texts t ON s.plan_handle = t.plan_handle{join}
        ORDER BY {order} DESC, s.plan_handle LIMIT 50"""

    @query(f"q1_top_queries_by_{by}", check)
    def _(t):
        return q.top_queries(t.query_stats, t.query_texts, by, 50, t.plans if plans else None)


_leader("worker_time", "s.total_worker_time", plans=True)
_leader("logical_reads", "s.total_logical_reads")
_leader("avg_elapsed_time", "s.total_elapsed_time // s.execution_count")
_leader("executions", "s.execution_count")
_leader("logical_writes", "s.total_logical_writes")


@query("q2_top_percent_queries", f"""
    WITH s AS (SELECT *, ROW_NUMBER() OVER (ORDER BY total_elapsed_time // execution_count DESC, plan_handle) AS rn, COUNT(*) OVER () AS n FROM bf_query_stats)
    SELECT plan_handle, execution_count, last_execution_time, {R('(total_elapsed_time // execution_count)', '1000', 3)} AS avg_seconds,
        {R('total_elapsed_time', '1000', 3)} AS total_seconds FROM s WHERE rn <= CEIL(n * 10 / 100.0)""")
def _(t):
    return q.top_percent_queries(t.query_stats, 10)


_PROC = f"""
    WITH s AS (SELECT s.*, p.name, DATEDIFF('minute', cached_time, TIMESTAMP '{AS_OF}') AS m FROM bf_proc_stats s JOIN bf_procedures p ON s.object_id = p.object_id)
    SELECT object_id, name AS procedure_name, execution_count, CAST(execution_count // m AS BIGINT) AS calls_per_minute,
        CAST(total_worker_time AS BIGINT) AS total_worker_time, CAST(total_worker_time // execution_count AS BIGINT) AS avg_worker_time, min_worker_time, max_worker_time,
        CAST(total_elapsed_time AS BIGINT) AS total_elapsed_time, CAST(total_elapsed_time // execution_count AS BIGINT) AS avg_elapsed_time,
        CAST(total_logical_reads AS BIGINT) AS total_logical_reads, CAST(total_logical_reads // execution_count AS BIGINT) AS avg_logical_reads,
        CAST(total_logical_writes AS BIGINT) AS total_logical_writes, CAST(total_logical_writes // execution_count AS BIGINT) AS avg_logical_writes,
        STRFTIME(last_execution_time, '%Y-%m-%d %H:%M:%S') AS last_execution_time, STRFTIME(cached_time, '%Y-%m-%d %H:%M:%S') AS plan_cached_time
    FROM s WHERE m > 0 """


def _procedures(by, order):
    @query(f"q3_top_procedures_by_{by}", f"{_PROC} ORDER BY {order} DESC, object_id LIMIT 25")
    def _(t):
        return q.top_procedures(t.proc_stats, t.procedures, by, AS_OF)


_procedures("executions", "s.execution_count")
_procedures("avg_elapsed_time", "s.total_elapsed_time // s.execution_count")
_procedures("worker_time", "s.total_worker_time")
_procedures("logical_reads", "s.total_logical_reads")
_procedures("elapsed_time", "s.total_elapsed_time")
_procedures("logical_writes", "s.total_logical_writes")


@query("q4_procedures_missing_index", f"""{_PROC} AND plan_handle IN (SELECT plan_handle FROM bf_plans WHERE query_plan LIKE '%<MissingIndexes>%')
    ORDER BY s.execution_count DESC, object_id LIMIT 25""")
def _(t):
    return q.procedures_missing_index(t.proc_stats, t.procedures, t.plans, AS_OF)


@query("q5_cpu_share_by_database", f"""
    WITH d AS (SELECT a.database_id, SUM(total_worker_time // 1000) AS ms FROM bf_query_stats s JOIN bf_plan_attributes a ON s.plan_handle = a.plan_handle GROUP BY 1)
    SELECT ROW_NUMBER() OVER (ORDER BY ms DESC, database_id) AS cpu_rank, database_id, CAST(ms AS BIGINT) AS cpu_time_ms,
        {R('ms', 'SUM(ms) OVER ()', 2, 100)} AS cpu_pct FROM d WHERE database_id <> 6""")
def _(t):
    return q.cpu_share_by_database(t.query_stats, t.plan_attributes, 6)


@query("q6_statement_text", """
    SELECT *, SUBSTRING(text, statement_start_offset // 2 + 1, GREATEST(0,
        ((CASE WHEN statement_end_offset = -1 THEN LENGTH(text) * 2 ELSE statement_end_offset END - statement_start_offset) // 2) + 1)) AS statement FROM bf_texts""")
def _(t):
    return q.add_statement_text(t.texts)


@query("q7_top_io_statements", """
    SELECT s.plan_handle, CAST((total_logical_reads + total_logical_writes) // execution_count AS BIGINT) AS avg_io, execution_count, SUBSTRING(text, 2) AS query_text
    FROM bf_query_stats s LEFT JOIN bf_statement_texts t ON s.plan_handle = t.plan_handle
    ORDER BY (total_logical_reads + total_logical_writes) // execution_count DESC, s.plan_handle LIMIT 50""")
def _(t):
    return q.top_io_statements(t.query_stats, t.statement_texts)


@query("q8_single_use_plans", """
    SELECT plan_handle, objtype, size_in_bytes // 1024 AS plan_size_kb, text AS query_text FROM bf_cached_plans
    WHERE usecounts = 1 AND objtype IN ('Adhoc', 'Prepared') ORDER BY size_in_bytes DESC, plan_handle LIMIT 50""")
def _(t):
    return q.single_use_plans(t.cached_plans)


@query("q9_adhoc_plan_ratio", f"""
    WITH s AS (SELECT SUM(CASE WHEN usecounts = 1 AND objtype = 'Adhoc' THEN size_in_bytes ELSE 0 END) AS a, SUM(size_in_bytes) AS n FROM bf_cached_plans),
    d AS (SELECT *, CASE WHEN value = 1 AND (a > 200 * 1048576 OR a * 100 > 25 * n) THEN 'plan stubs are on although such plans take little worth saving; switch them off'
        WHEN value = 0 AND a < 200 * 1048576 AND a * 100 < 25 * n THEN 'plan stubs are off; switch them on' END AS details FROM s, bf_adhoc_setting)
    SELECT {R('a', '1048576', 2)} AS adhoc_mb, {R('n', '1048576', 2)} AS total_mb, {R('a', 'n', 2, 100)} AS adhoc_pct, details FROM d WHERE details IS NOT NULL""")
def _(t):
    return q.adhoc_plan_ratio(t.cached_plans, t.adhoc_setting)


_MISS = """
    WITH m AS (SELECT *, COUNT(*) OVER (PARTITION BY statement) AS missing_for_table, COUNT(*) OVER (PARTITION BY statement, equality_columns) AS similar_missing FROM bf_missing),
    s AS (SELECT group_handle, {value} AS benefit, m.statement, equality_columns, inequality_columns, user_seeks, user_scans, avg_total_user_cost, avg_user_impact, last_user_seek,
        missing_for_table, similar_missing, CONCAT('CREATE NONCLUSTERED INDEX [IX_', m.statement, '_', equality_columns, CASE WHEN inequality_columns IS NOT NULL THEN '_' ELSE '' END,
        COALESCE(inequality_columns, ''), '] ON ', m.statement, ' (', equality_columns, CASE WHEN inequality_columns IS NOT NULL THEN ',' ELSE '' END, COALESCE(inequality_columns, ''), ')')
        AS create_index_statement FROM m)"""


@query("q10_missing_index_advice", _MISS.format(value="ROUND(user_seeks * avg_total_user_cost * avg_user_impact) / 100") + """
    SELECT s.*, r.table_rows FROM s LEFT JOIN (SELECT statement, CAST(SUM(row_count) AS BIGINT) AS table_rows FROM bf_missing_rows WHERE index_id < 2 GROUP BY 1) r ON s.statement = r.statement""")
def _(t):
    return q.missing_index_advice(t.missing, partitions=t.missing_rows)


@query("q10_missing_index_improvement", _MISS.format(value="ROUND(avg_total_user_cost * avg_user_impact * (user_seeks + user_scans) * 10) / 10") + """
    SELECT * FROM s WHERE benefit > 10 ORDER BY benefit DESC, group_handle LIMIT 50""")
def _(t):
    return q.missing_index_advice(t.missing, "improvement", 50)


@query("q11_missing_index_plans", """
    SELECT c.plan_handle, objtype, usecounts, size_in_bytes FROM bf_cached_plans c JOIN bf_plans p ON c.plan_handle = p.plan_handle
    WHERE query_plan LIKE '%MissingIndex%' ORDER BY usecounts DESC, c.plan_handle LIMIT 25""")
def _(t):
    return q.missing_index_plans(t.cached_plans, t.plans)


@query("q12_function_stats", """
    SELECT object_id, CAST(total_worker_time AS BIGINT) AS total_worker_time, execution_count, CAST(total_elapsed_time AS BIGINT) AS total_elapsed_time,
        CAST(total_elapsed_time // execution_count AS BIGINT) AS avg_elapsed_time, last_execution_time, cached_time
    FROM bf_function_stats s ORDER BY s.total_worker_time DESC, object_id LIMIT 25""")
def _(t):
    return q.function_stats(t.function_stats)


@query("q13_inlineable_functions", """
    SELECT m.object_id, name, is_inlineable, inline_type FROM bf_modules m JOIN bf_function_stats f ON m.object_id = f.object_id WHERE type_desc = 'SQL_SCALAR_FUNCTION'""")
def _(t):
    return q.inlineable_functions(t.modules, t.function_stats)


@query("q14_query_store_top_duration", f"""
    WITH d AS (SELECT query_id, SUM(count_executions * avg_duration) AS total, COUNT(DISTINCT plan_id) AS plan_count FROM bf_store_runtime
        WHERE start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 20000 HOUR AND execution_type_desc = 'Regular' GROUP BY query_id),
    r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY total DESC, query_id) AS duration_rank FROM d)
    SELECT r.query_id, CAST(total AS BIGINT) AS total_duration, plan_count, duration_rank, p.plan_id, p.is_forced_plan, p.query_plan
    FROM r JOIN bf_store_plans p ON r.query_id = p.query_id WHERE duration_rank <= 50""")
def _(t):
    return q.query_store_top_duration(t.store_runtime, t.store_plans, AS_OF, 20000)


@query("q15_queries_using_index", """
    SELECT plan_handle, database_id, execution_count, CAST(total_worker_time AS BIGINT) AS total_worker_time, min_worker_time, max_worker_time,
        CAST(total_elapsed_time AS BIGINT) AS total_elapsed_time, CAST(total_logical_reads AS BIGINT) AS total_logical_reads,
        CAST(total_logical_writes AS BIGINT) AS total_logical_writes, creation_time, last_execution_time
    FROM bf_query_stats WHERE plan_handle IN (SELECT plan_handle FROM bf_plans WHERE query_plan LIKE '%[IX_Brand#1]%')""")
def _(t):
    return q.queries_using_index(t.query_stats, t.plans, "[IX_Brand#1]")


@query("q15_store_queries_using_index", f"""
    SELECT r.query_id, CAST(SUM(count_executions) AS BIGINT) AS execution_count, CAST(SUM(count_executions * avg_duration) AS BIGINT) AS exact_duration,
        {R('(SUM(count_executions) * SUM(avg_duration))', 'COUNT(*)', 2)} AS est_duration, MIN(start_time) AS min_execution_time,
        MAX(start_time) AS last_execution_time, MAX(r.plan_id) AS latest_plan_id
    FROM bf_store_runtime r JOIN bf_store_plans p ON r.query_id = p.query_id AND r.plan_id = p.plan_id WHERE query_plan LIKE '%IX_1-URGENT%' GROUP BY r.query_id""")
def _(t):
    return q.store_queries_using_index(t.store_runtime, t.store_plans, "IX_1-URGENT")


@query("q16_forced_index_plans", """
    SELECT s.plan_handle, database_id, execution_count, CAST(total_worker_time AS BIGINT) AS total_worker_time, min_worker_time, max_worker_time,
        CAST(total_elapsed_time AS BIGINT) AS total_elapsed_time, CAST(total_logical_reads AS BIGINT) AS total_logical_reads,
        CAST(total_logical_writes AS BIGINT) AS total_logical_writes, creation_time, last_execution_time, t.text
    FROM bf_query_stats s JOIN bf_plans p ON s.plan_handle = p.plan_handle JOIN bf_hinted_texts t ON s.plan_handle = t.plan_handle
    WHERE query_plan LIKE '%ForcedIndex="1"%' AND UPPER(t.text) LIKE '%INDEX%'""")
def _(t):
    return q.forced_index_plans(t.query_stats, t.hinted_texts, t.plans)


@query("q21_progress_eta", f"""
    WITH a AS (SELECT session_id, SUM(row_count) AS done, SUM(estimate_row_count) AS total, MAX(last_active_time) - MIN(first_active_time) AS ms,
            MAX(CASE WHEN close_time = 0 AND first_row_time > 0 THEN physical_operator_name ELSE '' END) AS current_step
        FROM bf_profiles WHERE physical_operator_name IN ('Table Scan', 'Clustered Index Scan', 'Sort', 'Index Insert', 'Index Scan') GROUP BY session_id),
    b AS (SELECT *, CAST(ms * (total - done) // (done * 1000) AS BIGINT) AS secs FROM a)
    SELECT session_id, current_step, CAST(total AS BIGINT) AS total_rows, CAST(done AS BIGINT) AS rows_processed, CAST(total - done AS BIGINT) AS rows_left,
        {R('done', 'total', 2, 100)} AS percent_complete, {R('ms', '1000', 3)} AS elapsed_seconds, secs AS estimated_seconds_left,
        TIMESTAMP '{AS_OF}' + TO_SECONDS(secs) AS estimated_completion_time FROM b""")
def _(t):
    return q.progress_eta(t.profiles, AS_OF)


def _spoken(s):
    return f"CAST(({s}) // 3600 AS VARCHAR) || ' hour(s), ' || CAST((({s}) % 3600) // 60 AS VARCHAR) || ' min, ' || CAST(({s}) % 60 AS VARCHAR) || ' sec'"


@query("q22_backup_restore_progress", f"""
    SELECT session_id, request_id, command, {_spoken(f"DATEDIFF('second', start_time, TIMESTAMP '{EVENTS_AS_OF}')")} AS running_time,
        {_spoken('estimated_completion_time // 1000')} AS est_time_to_go, TIMESTAMP '{EVENTS_AS_OF}' + TO_SECONDS(estimated_completion_time // 1000) AS est_completion_time
    FROM bf_requests WHERE command IN ('view', 'click')""")
def _(t):
    return q.backup_restore_progress(t.requests, EVENTS_AS_OF, ("view", "click"))


def _clock(ms):
    return f"""LPAD(CAST(({ms}) // 3600000 % 24 AS VARCHAR), 2, '0') || ':' || LPAD(CAST(({ms}) // 60000 % 60 AS VARCHAR), 2, '0') || ':' || LPAD(CAST(({ms}) // 1000 % 60 AS VARCHAR), 2, '0')"""


def _current(by):
    @query(f"q23_current_requests_by_{by}", f"""
        SELECT r.*, login_name, host_name, program_name, login_time, CAST(total_elapsed_time // 86400000 AS VARCHAR) || 'd ' || {_clock('total_elapsed_time')} AS elapsed_time
        FROM bf_requests r JOIN bf_user_sessions s ON r.session_id = s.session_id ORDER BY r.{by} DESC, request_id LIMIT 50""")
    def _(t):
        return q.current_requests(t.requests, t.user_sessions, by=by, n=50)


_current("cpu_time")
_current("total_elapsed_time")


@query("q24_connections_by_client", """
    SELECT client_net_address, program_name, host_name, login_name, COUNT(*) AS connection_count
    FROM bf_connections c JOIN bf_user_sessions s ON c.session_id = s.session_id GROUP BY ALL""")
def _(t):
    return q.connections_by_client(t.user_sessions, t.connections)


@query("q25_input_buffers", """
    SELECT s.*, event_info AS input_buffer FROM bf_user_sessions s LEFT JOIN bf_input_buffers b ON s.session_id = b.session_id
    WHERE s.session_id > 50 AND s.session_id <> 77""")
def _(t):
    return q.input_buffers(t.user_sessions, t.input_buffers, 50, 77)


@query("q26_task_profile", """
    WITH w AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id, task_id ORDER BY wait_duration_ms DESC, wait_type) AS rn FROM bf_current_waits),
    s AS (SELECT session_id, wait_type, SUM(wait_time_ms) AS ms FROM bf_session_waits GROUP BY 1, 2 HAVING SUM(wait_time_ms) > 500),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY ms DESC, wait_type) AS rn FROM s),
    l AS (SELECT session_id, STRING_AGG(wait_type || ' (' || CAST(CAST(ms AS BIGINT) AS VARCHAR) || ' ms)', ', ' ORDER BY rn) AS top_waits FROM r WHERE rn <= 5 GROUP BY session_id)
    SELECT t.*, CASE WHEN parent_task_id IS NULL THEN 1 ELSE 0 END AS is_parent, node_id, row_count, physical_operator_name, w.wait_type, w.wait_duration_ms, top_waits
    FROM bf_tasks t LEFT JOIN bf_profiles p ON t.session_id = p.session_id AND t.task_id = p.task_id
    LEFT JOIN w ON w.session_id = t.session_id AND w.task_id = t.task_id AND rn = 1 LEFT JOIN l ON l.session_id = t.session_id""")
def _(t):
    return q.task_profile(t.tasks, t.profiles, t.current_waits, t.session_waits)
