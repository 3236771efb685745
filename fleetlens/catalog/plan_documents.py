"""Document queries over the given tables. Documents are built from rows and
shredded again, so the rows themselves are the check."""

from fleetlens.catalog.registry import FRAMES, query
from fleetlens.operators import documents as d

AS_OF = "2024-01-31 00:00:00"
TICKS = 2_000_000_000

FRAMES.update(
    bf_plan_columns="""
        SELECT 'dbo' AS schema_name, p_type AS table_name, p_brand AS column_name, MIN(CASE WHEN p_size % 2 = 0 THEN 'varchar' ELSE 'char' END) AS data_type, MIN(p_size) AS max_length FROM part GROUP BY p_type, p_brand""",
    bf_plan_objects="""SELECT p_partkey AS plan_handle, p_size % 20 AS database_id, p_partkey % 500 AS object_id FROM part""",
    bf_table_params="""SELECT DISTINCT p_size % 20 AS database_id, p_partkey % 500 AS object_id FROM part WHERE p_partkey % 3 = 0""",
    bf_unreadable="""SELECT n_nationkey AS database_id FROM nation WHERE n_nationkey % 7 = 0""",
    bf_ring="""
        SELECT user_id AS instance_id, CASE WHEN event_type = 'error' THEN 'RING_BUFFER_OTHER' ELSE 'RING_BUFFER_SCHEDULER_MONITOR' END AS ring_buffer_type, event_id * 1000 AS timestamp,
            CONCAT('<Record id="', CAST(event_id AS VARCHAR(20)), '"><SchedulerMonitorEvent><SystemHealth><ProcessUtilization>', CAST(CAST(FLOOR(value) AS BIGINT) % 60 AS VARCHAR(20)), '</ProcessUtilization><SystemIdle>',
                CAST(event_id % 40 AS VARCHAR(20)), '</SystemIdle></SystemHealth></SchedulerMonitorEvent></Record>') AS record FROM events""",
    bf_resource_ring="""
        SELECT user_id AS instance_id, 'RING_BUFFER_RESOURCE_MONITOR' AS ring_buffer_type, event_id * 100000 AS timestamp,
            CONCAT('<Record id="', CAST(event_id AS VARCHAR(20)), '"><ResourceMonitor><IndicatorsSystem>', CAST(event_id % 4 AS VARCHAR(20)), '</IndicatorsSystem></ResourceMonitor></Record>') AS record FROM events""",
    bf_deadlock_xml="""
        SELECT o_orderkey AS event_id, CONCAT('<event name="xml_deadlock_report" timestamp="2024-01-0', CAST(o_orderkey % 9 + 1 AS VARCHAR(20)), ' 10:00:00"><data name="xml_report"><value><deadlock><victim-list><victimProcess id="p',
            CAST(o_orderkey % 2 AS VARCHAR(20)), '"/></victim-list><process-list><process id="p0" hostname="host0" clientapp="app" currentdb="', CAST(o_custkey % 5 AS VARCHAR(20)),
            '" transactionname="user" isolationlevel="read"/><process id="p1" hostname="', o_orderpriority, '" clientapp="app1" currentdb="1" transactionname="implicit" isolationlevel="snap"/></process-list></deadlock></value></data></event>')
            AS event_xml FROM orders""",
    bf_state_xml="""
        SELECT event_id, CONCAT('<event name="', CASE WHEN event_type IN ('view', 'click') THEN 'availability_replica_state_change' ELSE 'error_reported' END, '" timestamp="2024-01-0', CAST(event_id % 9 + 1 AS VARCHAR(20)),
            ' 01:02:03"><data name="availability_group_name"><value>ag', CAST(user_id % 3 AS VARCHAR(20)), '</value></data><data name="previous_state"><value>1</value><text>', event_type,
            '</text></data><data name="current_state"><value>2</value><text>now</text></data><data name="availability_replica_id"><value>', CAST(user_id AS VARCHAR(20)),
            '</value></data><data name="error_number"><value>', CAST(900 + event_id % 100 AS VARCHAR(20)), '</value></data><data name="message"><value>failed ', CAST(event_id AS VARCHAR(20)), '</value></data></event>') AS event_xml
        FROM events""",
)


@query("p46_shred_events", """
    SELECT event_id, ts, event_type AS event_name, CAST(user_id AS VARCHAR) AS event_timestamp, CAST(CAST(ROUND(value * 100) AS BIGINT) AS VARCHAR) AS value FROM events""")
def _(t):
    return d.parse_events(t.event_xml).selectExpr("event_id", "ts", "event_name", "event_timestamp", "data['value'] AS value")


@query("q17_parallel_plans_below_cost", """
    SELECT p_name || ' ' || CAST(p_partkey AS VARCHAR) AS statement_text, p_partkey AS plan_handle, usecounts, size_in_bytes, p_size + 0.5::DOUBLE AS subtree_cost
    FROM part JOIN bf_cached_plans ON plan_handle = p_partkey WHERE p_size % 4 = 0 AND usecounts > 0 AND p_size + 0.5 <= 30""")
def _(t):
    return d.parallel_plans_below_cost(t.cached_plans, t.plans, 0, 30)


@query("q18_implicit_conversions", """
    SELECT p_partkey AS plan_handle, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS statement, 'dbo' AS schema_name, p_type AS table_name, p_brand AS column_name, 'nvarchar' AS convert_to, p_size AS convert_to_length,
        data_type AS convert_from, max_length AS convert_from_length FROM part JOIN bf_plan_columns c ON c.table_name = p_type AND c.column_name = p_brand WHERE p_size % 2 = 0""")
def _(t):
    return d.implicit_conversions(t.plans, t.plan_columns)


@query("q19_non_sargable_scans", """
    SELECT p_partkey AS plan_handle, p_name || ' ' || CAST(p_partkey AS VARCHAR) AS statement, '[dbo]' AS schema_name, '[' || p_type || ']' AS table_name, p_brand AS column_name,
        CASE WHEN p_size % 4 = 1 THEN 'TableScan' ELSE 'IndexScan' END AS scan_type, 'f(' || p_brand || ')' AS scalar_string FROM part""")
def _(t):
    return d.non_sargable_scans(t.plans)


@query("q20_table_variable_plans", """
    SELECT o.database_id, o.object_id, COUNT(*) AS plan_count, CAST(SUM(usecounts) AS BIGINT) AS total_use_count FROM part JOIN bf_cached_plans c ON c.plan_handle = p_partkey JOIN bf_plan_objects o ON o.plan_handle = p_partkey
    WHERE p_size % 7 = 0 AND objtype = 'Proc' AND o.database_id > 4 AND o.database_id NOT IN (SELECT database_id FROM bf_unreadable)
        AND NOT EXISTS (SELECT 1 FROM bf_table_params x WHERE x.database_id = o.database_id AND x.object_id = o.object_id) GROUP BY 1, 2""")
def _(t):
    return d.table_variable_plans(t.cached_plans, t.plans, t.plan_objects, t.table_params, t.unreadable)


@query("m1_cpu_history", f"""
    WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type <> 'error')
    SELECT user_id AS instance_id, event_id AS record_id, CAST(CAST(FLOOR(value) AS BIGINT) % 60 AS INTEGER) AS process_utilization, CAST(event_id % 40 AS INTEGER) AS system_idle,
        TIMESTAMP '{AS_OF}' - TO_MILLISECONDS({TICKS} - event_id * 1000) AS event_time, CAST(100 - event_id % 40 - CAST(FLOOR(value) AS BIGINT) % 60 AS INTEGER) AS other_utilization FROM r WHERE rn <= 20""")
def _(t):
    return d.cpu_history(t.ring, AS_OF, TICKS, 20)


@query("m13_low_memory_notifications", f"""
    SELECT user_id AS instance_id, COUNT(*) AS notifications, TIMESTAMP '{AS_OF}' + TO_MILLISECONDS(MAX(event_id * 100000) - {TICKS}) AS last_time FROM events
    WHERE event_id % 4 = 2 AND {TICKS} - event_id * 100000 < 30000 * 60000 GROUP BY 1""")
def _(t):
    return d.low_memory_notifications(t.resource_ring, AS_OF, TICKS, 30000)


@query("s16_deadlock_events", """
    WITH v AS (SELECT o_orderkey AS event_id, CAST('2024-01-0' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || ' 10:00:00' AS TIMESTAMP) AS event_time, CASE WHEN o_orderkey % 2 = 0 THEN 'host0' ELSE o_orderpriority END AS host_name,
        CASE WHEN o_orderkey % 2 = 0 THEN 'app' ELSE 'app1' END AS client_app, CAST(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 5 ELSE 1 END AS INTEGER) AS database_id,
        CASE WHEN o_orderkey % 2 = 0 THEN 'user' ELSE 'implicit' END AS transaction_name, CASE WHEN o_orderkey % 2 = 0 THEN 'read' ELSE 'snap' END AS isolation_level FROM orders)
    SELECT v.*, x.event_xml AS graph, name AS database_name FROM v JOIN bf_deadlock_xml x ON x.event_id = v.event_id LEFT JOIN bf_five_databases f ON f.database_id = v.database_id""")
def _(t):
    return d.deadlock_events(t.deadlock_xml, t.five_databases)


@query("h5_replica_state_changes", """
    SELECT event_id, CAST('2024-01-0' || CAST(event_id % 9 + 1 AS VARCHAR) || ' 01:02:03' AS TIMESTAMP) + INTERVAL 3 HOUR AS event_time, 'ag' || CAST(user_id % 3 AS VARCHAR) AS group_name, event_type AS previous_state,
        'now' AS current_state, user_id AS replica_id, replica_name FROM events JOIN bf_ag_replicas ON replica_id = user_id WHERE event_type IN ('view', 'click')""")
def _(t):
    return d.replica_state_changes(t.state_xml, t.ag_replicas, 3)


@query("h6_ha_errors", """
    SELECT event_id, CAST('2024-01-0' || CAST(event_id % 9 + 1 AS VARCHAR) || ' 01:02:03' AS TIMESTAMP) AS event_time, CAST(900 + event_id % 100 AS INTEGER) AS error_number, 'failed ' || CAST(event_id AS VARCHAR) AS message, severity
    FROM events LEFT JOIN bf_messages m ON m.message_id = 900 + event_id % 100 WHERE event_type NOT IN ('view', 'click')""")
def _(t):
    return d.ha_errors(t.state_xml, t.messages)
