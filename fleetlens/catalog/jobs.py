"""Job queries over the given tables."""

from fleetlens.catalog.registry import FRAMES, query
from fleetlens.operators import jobs as j

AS_OF = "2024-01-31 00:00:00"

FRAMES.update(
    bf_jobs="""
        SELECT c_custkey AS job_id, c_name AS name, c_nationkey AS category_id, c_custkey % 9 <> 0 AS enabled, c_custkey % 70 AS owner_sid, CASE WHEN c_custkey % 13 <> 0 THEN c_mktsegment END AS owner_name,
            CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '2024-01-30 23:50:00' ELSE TIMESTAMP '2023-01-01 00:00:00' END AS date_created FROM customer""",
    bf_job_categories="""SELECT n_nationkey AS category_id, n_name AS name FROM nation""",
    bf_schedule_links="""SELECT p_partkey % 400 AS job_id, p_partkey AS schedule_id, CASE WHEN p_size % 5 = 0 THEN 0 ELSE 20240200 + p_size % 28 + 1 END AS next_run_date, p_size % 24 * 10000 + 1530 AS next_run_time, p_size % 3 > 0 AS enabled FROM part""",
    bf_job_servers="""
        SELECT c_custkey AS job_id, c_custkey % 4 AS last_run_outcome, CASE WHEN c_custkey % 6 = 0 THEN 0 ELSE 20240100 + c_custkey % 28 + 1 END AS last_run_date, c_custkey % 24 * 10000 + 101 AS last_run_time,
            CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS last_outcome_message FROM customer""",
    bf_job_steps="""SELECT o_custkey AS job_id, o_orderkey AS step_uid FROM orders""",
    bf_job_alerts="""SELECT o_custkey AS job_id, o_orderstatus = 'F' AS enabled FROM orders""",
    bf_logins="""SELECT s_suppkey AS sid, s_name AS name, s_suppkey % 17 = 0 AS denylogin, s_suppkey % 19 <> 0 AS hasaccess FROM supplier""",
    bf_sysadmins="""SELECT s_suppkey AS sid FROM supplier WHERE s_suppkey % 2 = 0""",
    bf_job_activity="""
        SELECT event_id AS activity_id, user_id AS job_id, event_id % 3 AS session_id, ts AS run_requested_date, CASE WHEN event_type = 'view' THEN ts END AS stop_execution_date,
            CASE WHEN event_type <> 'click' THEN event_id % 9 END AS last_executed_step_id FROM events""",
    bf_agent_sessions="""SELECT r_regionkey AS session_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 DAY AS agent_start_date FROM region""",
    bf_agent_alerts="""SELECT p_partkey AS alert_id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 820 + p_partkey % 10 ELSE 0 END AS message_id, CASE WHEN p_size % 2 = 1 THEN p_size % 4 ELSE 0 END AS severity FROM part""",
    bf_messages="""SELECT p_partkey + 600 AS message_id, p_partkey % 25 + 1 AS severity, p_name AS text FROM part""",
)


def _pad(x):
    return f"LPAD(CAST({x} AS VARCHAR), 2, '0')"


def _hms(x):
    return f"{_pad(f'({x}) // 10000')} || ':' || {_pad(f'({x}) // 100 % 100')} || ':' || {_pad(f'({x}) % 100')}"


def _secs(x):
    return f"(({x}) // 10000 * 3600 + ({x}) // 100 % 100 * 60 + ({x}) % 100)"


def _stamp(d, t):
    return f"MAKE_TIMESTAMP(({d}) // 10000, ({d}) // 100 % 100, ({d}) % 100, ({t}) // 10000, ({t}) // 100 % 100, CAST(({t}) % 100 AS DOUBLE))"


@query("j1_last_job_runs", f"""
    WITH h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY history_id DESC) AS rn FROM bf_job_history)
    SELECT j.job_id, j.name, c.name AS category_name, run_status, {_hms('run_duration')} AS last_duration, {_secs('run_duration')} AS last_duration_s, {_stamp('run_date', 'run_time')} AS last_start
    FROM bf_jobs j JOIN h ON j.job_id = h.job_id AND rn = 1 JOIN bf_job_categories c ON c.category_id = j.category_id""")
def _(t):
    return j.last_job_runs(t.jobs, t.job_history, t.job_categories)


@query("j2_decode_agent_time", f"""
    SELECT job_id, history_id, run_status, CAST(run_date AS INTEGER) AS run_date, CAST(run_time AS INTEGER) AS run_time, run_duration, {_stamp('run_date', 'run_time')} AS run_start, {_secs('run_duration')} AS duration_s,
        {_hms('run_duration')} AS duration_text FROM bf_job_history""")
def _(t):
    return j.decode_agent_time(t.job_history)


_DAYS = "ARRAY_TO_STRING(LIST_FILTER([" + ", ".join(f"CASE WHEN freq_interval & {1 << i} > 0 THEN '{d}' END" for i, d in enumerate(j.WEEK)) + "], lambda x: x IS NOT NULL), ', ')"
_WORDS = f"""CASE freq_type WHEN 4 THEN 'Daily' WHEN 8 THEN 'Weekly' WHEN 16 THEN 'Monthly' END AS occurs,
        CASE freq_type WHEN 4 THEN 'Every ' || CAST(freq_interval AS VARCHAR) || ' day(s)' WHEN 8 THEN 'Every 1 week(s) on ' || {_DAYS} WHEN 16 THEN 'Day ' || CAST(freq_interval AS VARCHAR) || ' of every 1 month(s)' END AS occurs_detail,
        'Occurs ' || CASE WHEN freq_subday_type = 1 THEN 'once at ' || {_hms('active_start_time')} ELSE 'every ' || CAST(freq_subday_interval AS VARCHAR) || ' ' ||
            CASE freq_subday_type WHEN 2 THEN 'Second' WHEN 4 THEN 'Minute' ELSE 'Hour' END || '(s) from ' || {_hms('active_start_time')} END AS frequency"""


@query("j3_describe_schedules", f"SELECT *, {_WORDS} FROM bf_job_schedules")
def _(t):
    return j.describe_schedules(t.job_schedules)


@query("j3_job_schedules", f"""
    WITH a AS (SELECT job_id, SUM({_secs('run_duration')}) // COUNT(*) AS avg_duration_s FROM bf_job_history GROUP BY 1), w AS (SELECT schedule_id, {_WORDS} FROM bf_job_schedules)
    SELECT j.job_id, j.name, c.name AS category_name, j.enabled, l.schedule_id, occurs, occurs_detail, frequency, CAST(avg_duration_s AS BIGINT) AS avg_duration_s,
        CASE WHEN next_run_date > 0 THEN {_stamp('next_run_date', 'next_run_time')} END AS next_run
    FROM bf_jobs j JOIN bf_job_categories c ON c.category_id = j.category_id LEFT JOIN bf_schedule_links l ON l.job_id = j.job_id LEFT JOIN w ON w.schedule_id = l.schedule_id LEFT JOIN a ON a.job_id = j.job_id""")
def _(t):
    return j.job_schedules(t.jobs, t.schedule_links, t.job_schedules, t.job_categories, t.job_history)


@query("j4_misconfigured_jobs", f"""
    WITH n AS (SELECT j.job_id, name, owner_name, COALESCE(a.n, 0) AS target_count, COALESCE(b.n, 0) AS step_count, COALESCE(c.n, 0) AS schedule_count, COALESCE(d.n, 0) AS alert_count, COALESCE(e.n, 0) AS recent_run_count FROM bf_jobs j
        LEFT JOIN (SELECT job_id, COUNT(*) AS n FROM bf_job_servers GROUP BY 1) a ON a.job_id = j.job_id LEFT JOIN (SELECT job_id, COUNT(*) AS n FROM bf_job_steps GROUP BY 1) b ON b.job_id = j.job_id
        LEFT JOIN (SELECT job_id, COUNT(*) AS n FROM bf_schedule_links WHERE enabled GROUP BY 1) c ON c.job_id = j.job_id LEFT JOIN (SELECT job_id, COUNT(*) AS n FROM bf_job_alerts WHERE enabled GROUP BY 1) d ON d.job_id = j.job_id
        LEFT JOIN (SELECT job_id, COUNT(*) AS n FROM bf_job_history WHERE run_date > 20231231 GROUP BY 1) e ON e.job_id = j.job_id WHERE date_created < TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE)
    SELECT * EXCLUDE (owner_name), 'No target server' AS finding FROM n WHERE target_count = 0 UNION ALL SELECT * EXCLUDE (owner_name), 'No steps' FROM n WHERE step_count = 0
    UNION ALL SELECT * EXCLUDE (owner_name), 'nothing starts it and it has not run lately' FROM n WHERE schedule_count = 0 AND alert_count = 0 AND recent_run_count = 0
    UNION ALL SELECT * EXCLUDE (owner_name), 'No valid owner' FROM n WHERE owner_name IS NULL""")
def _(t):
    return j.misconfigured_jobs(t.jobs, t.job_servers, t.job_steps, t.schedule_links, t.job_alerts, t.job_history, AS_OF)


@query("j5_orphaned_jobs", f"""
    WITH h AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY run_date DESC, run_time DESC, history_id DESC) AS rn FROM bf_job_history WHERE run_date > 0),
    n AS (SELECT job_id, next_run_date, next_run_time, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY next_run_date, next_run_time) AS rn FROM bf_schedule_links WHERE next_run_date > 0),
    i AS (SELECT j.job_id, j.name, owner_name, a.sid IS NOT NULL AS is_sysadmin, CASE WHEN owner_name IS NULL THEN 'nobody with the owner''s name' WHEN l.sid IS NULL THEN 'the owner is no login of this server'
        WHEN denylogin OR NOT hasaccess THEN 'the owner may not connect' WHEN a.sid IS NULL THEN 'the owner is no administrator' END AS issue
        FROM bf_jobs j LEFT JOIN bf_logins l ON j.owner_sid = l.sid LEFT JOIN bf_sysadmins a ON a.sid = j.owner_sid WHERE j.enabled)
    SELECT i.*, {_stamp('h.run_date', 'h.run_time')} AS last_run, CASE run_status WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Retry' WHEN 3 THEN 'Canceled' END AS last_status,
        {_secs('run_duration')} AS last_duration_s, {_stamp('n.next_run_date', 'n.next_run_time')} AS next_run
    FROM i LEFT JOIN h ON h.job_id = i.job_id AND h.rn = 1 LEFT JOIN n ON n.job_id = i.job_id AND n.rn = 1 WHERE issue IS NOT NULL""")
def _(t):
    return j.orphaned_jobs(t.jobs, t.logins, t.sysadmins, t.job_history, t.schedule_links)


@query("j6_failed_jobs", f"""
    SELECT j.job_id, name, COALESCE(last_outcome_message, '') || ' (' || STRFTIME({_stamp('last_run_date', 'last_run_time')}, '%Y-%m-%d %H:%M:%S') || ')' AS details
    FROM bf_jobs j JOIN bf_job_servers s ON j.job_id = s.job_id WHERE enabled AND last_run_outcome IN (0, 3) AND last_run_date > 0""")
def _(t):
    return j.failed_jobs(t.jobs, t.job_servers)


@query("j7_running_jobs", f"""
    SELECT a.job_id, name, run_requested_date AS started, DATE_DIFF('second', run_requested_date, TIMESTAMP '{AS_OF}') AS elapsed_s,
        CASE WHEN last_executed_step_id IS NULL THEN 'Step 1 executing' ELSE 'Step ' || CAST(last_executed_step_id + 1 AS VARCHAR) || ' executing' END AS progress
    FROM bf_job_activity a JOIN bf_jobs j ON a.job_id = j.job_id WHERE stop_execution_date IS NULL AND session_id = (SELECT MAX(session_id) FROM bf_agent_sessions)""")
def _(t):
    return j.running_jobs(t.job_activity, t.agent_sessions, t.jobs, AS_OF)


@query("j8_agent_alerts", "SELECT alert_id, name, message_id, severity FROM bf_agent_alerts")
def _(t):
    return j.agent_alerts(t.agent_alerts)


@query("j8_missing_alerts", f"""
    SELECT m.*, 'Error ' || CAST(message_id AS VARCHAR) || ': ' || text AS details FROM bf_messages m WHERE message_id IN {j.ALERT_MESSAGES}
        AND NOT EXISTS (SELECT 1 FROM bf_agent_alerts a WHERE a.severity > 0 AND a.severity = m.severity) AND NOT EXISTS (SELECT 1 FROM bf_agent_alerts a WHERE a.message_id > 0 AND a.message_id = m.message_id)""")
def _(t):
    return j.missing_alerts(t.agent_alerts, t.messages)
