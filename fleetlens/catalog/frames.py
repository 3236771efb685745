"""Telemetry-shaped frames over the given tables, as SQL that Spark and DuckDB both run."""

from fleetlens.catalog.registry import FRAMES

FRAMES.update(
    bf_waits="""
        SELECT p_brand AS wait_type, SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT))*100 AS wait_time_ms,
            SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)*CAST(ROUND(l_discount*100) AS BIGINT)) AS signal_wait_time_ms,
            COUNT(*) AS waiting_tasks_count
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY p_brand""",
    bf_benign="""
        SELECT DISTINCT p_brand AS wait_type
        FROM part
        WHERE p_brand LIKE '%3'""",
    bf_waiting_tasks="""
        SELECT l_suppkey AS session_id, l_orderkey*10+l_linenumber AS task_id, p_type AS wait_type,
            CAST(l_quantity AS BIGINT) AS wait_duration_ms
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    bf_file_stats="""
        SELECT l_suppkey AS database_id, l_linenumber AS file_id,
            SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS num_of_reads,
            SUM(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) AS num_of_writes,
            SUM(CASE WHEN l_returnflag='R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS io_stall_read_ms,
            SUM(CASE WHEN l_returnflag='A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS io_stall_write_ms,
            SUM(CASE WHEN l_returnflag='R' THEN CAST(ROUND(l_extendedprice*100) AS BIGINT) ELSE 0 END) AS num_of_bytes_read,
            SUM(CASE WHEN l_returnflag='A' THEN CAST(ROUND(l_extendedprice*100) AS BIGINT) ELSE 0 END) AS num_of_bytes_written
        FROM lineitem
        GROUP BY l_suppkey, l_linenumber""",
    bf_files="""
        SELECT DISTINCT l_suppkey AS database_id, l_linenumber AS file_id,
            CONCAT(CASE WHEN l_linenumber % 2 = 0 THEN 'd' ELSE 'e' END, ':/f', CAST(l_linenumber AS VARCHAR(10))) AS physical_name,
            CASE WHEN l_linenumber = 7 THEN 1 ELSE 0 END AS type, l_suppkey*128 AS size
        FROM lineitem""",
    bf_query_stats="""
        SELECT l_partkey AS plan_handle, l_partkey % 7 AS database_id, COUNT(*) AS execution_count,
            SUM(CAST(l_quantity AS BIGINT)*1000) AS total_worker_time,
            MIN(CAST(l_quantity AS BIGINT)*1000) AS min_worker_time, MAX(CAST(l_quantity AS BIGINT)*1000) AS max_worker_time,
            SUM(CAST(ROUND(l_extendedprice*100) AS BIGINT)) AS total_elapsed_time, SUM(l_suppkey) AS total_logical_reads,
            SUM(l_linenumber) AS total_logical_writes, MIN(l_shipdate) AS creation_time,
            MAX(l_shipdate) AS last_execution_time
        FROM lineitem
        GROUP BY l_partkey""",
    bf_query_texts="""
        SELECT p_partkey AS plan_handle, p_name AS text
        FROM part""",
    bf_texts="""
        SELECT doc_id AS id, text, CAST(doc_id % 40 AS INT)*2 AS statement_start_offset,
            CASE WHEN doc_id % 3 = 0 THEN -1 ELSE CAST(doc_id % 40 AS INT)*2 + 60 END AS statement_end_offset
        FROM documents""",
    bf_filters="""
        SELECT p_partkey AS id,
            CONCAT('([', p_type, '] = 1 AND [', p_brand, '] > ', CAST(p_size AS VARCHAR(10)), ')') AS filter_definition
        FROM part""",
    bf_cached_plans="""
        SELECT p_partkey AS plan_handle, p_size % 4 + 1 AS usecounts,
            CASE p_size % 3 WHEN 0 THEN 'Adhoc' WHEN 1 THEN 'Prepared' ELSE 'Proc' END AS objtype,
            CAST(ROUND(p_retailprice*100) AS BIGINT) AS size_in_bytes, p_name AS text
        FROM part""",
    bf_missing="""
        SELECT p_partkey AS group_handle, p_type AS statement, p_brand AS equality_columns,
            CASE WHEN p_size % 2 = 0 THEN p_name END AS inequality_columns,
            CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS user_seeks, COUNT(*) AS user_scans,
            CAST(p_size AS DOUBLE) AS avg_total_user_cost, CAST(p_size % 100 AS DOUBLE) AS avg_user_impact,
            MAX(l_shipdate) AS last_user_seek
        FROM part JOIN lineitem ON l_partkey = p_partkey
        GROUP BY p_partkey, p_type, p_brand, p_size, p_name""",
    bf_store_runtime="""
        SELECT o_custkey AS query_id, o_orderkey AS plan_id, o_orderdate AS start_time,
            CASE WHEN o_orderstatus='P' THEN 'Aborted' ELSE 'Regular' END AS execution_type_desc,
            COUNT(*) AS count_executions, CAST(MAX(l_quantity) AS BIGINT) AS avg_duration
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY o_custkey, o_orderkey, o_orderdate, o_orderstatus""",
    bf_requests="""
        SELECT event_id AS request_id, user_id AS session_id, event_type AS command, ts AS start_time,
            CAST(FLOOR(value*100000) AS BIGINT) AS total_elapsed_time, CAST(FLOOR(value*1000) AS BIGINT) AS cpu_time,
            user_id % 5 AS database_id, CAST(FLOOR(value*50000) AS BIGINT) AS estimated_completion_time
        FROM events""",
    bf_sessions="""
        SELECT s_suppkey + 1 AS session_id,
            CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE CAST(FLOOR((s_suppkey + 1) / 2.0) AS BIGINT) END AS blocking_session_id,
            s_name AS login_name, CASE WHEN s_acctbal < 0 THEN 'sleeping' ELSE 'running' END AS status,
            s_nationkey AS database_id, s_suppkey % 3 AS open_tran_count, s_suppkey % 6 AS transaction_isolation_level
        FROM supplier""",
    bf_locks="""
        SELECT l_suppkey AS request_session_id,
            CASE l_linenumber % 4 WHEN 0 THEN 'OBJECT' WHEN 1 THEN 'KEY' WHEN 2 THEN 'PAGE' ELSE 'DATABASE' END AS resource_type,
            l_partkey AS resource_associated_entity_id, l_returnflag AS request_mode, l_linestatus AS request_status,
            l_suppkey % 5 AS resource_database_id
        FROM lineitem""",
    bf_transactions="""
        SELECT o_orderkey AS transaction_id, o_custkey AS session_id, o_custkey % 5 AS database_id,
            o_orderkey % 4 + 1 AS database_transaction_type, o_orderkey % 9 AS database_transaction_state,
            o_orderdate AS begin_time, CAST(ROUND(o_totalprice*100) AS BIGINT) AS log_bytes_used
        FROM orders""",
    bf_counters="""
        SELECT CASE event_type WHEN 'click' THEN 'Total Server Memory (KB)' WHEN 'view' THEN 'Target Server Memory (KB)' WHEN 'error' THEN 'Number of Deadlocks/sec' WHEN 'signup' THEN 'Page life expectancy' ELSE 'Database Cache Memory (KB)' END AS counter_name,
            CASE WHEN event_type = 'signup' THEN 'SQLServer:Buffer Node' ELSE 'SQLServer:Memory Manager' END AS object_name,
            CAST(user_id % 3 AS VARCHAR(10)) AS instance_name, SUM(CAST(ROUND(value*100) AS BIGINT)) AS cntr_value
        FROM events
        GROUP BY event_type, user_id % 3""",
    bf_buffers="""
        SELECT l_suppkey AS database_id, l_linenumber AS file_id, l_orderkey*10+l_linenumber AS page_id,
            l_partkey AS allocation_unit_id, CAST(l_quantity AS BIGINT) AS free_space_in_bytes
        FROM lineitem""",
    bf_config="""
        SELECT c_nationkey AS instance_id, c_mktsegment AS name, COUNT(*) % 4 AS value
        FROM customer
        GROUP BY c_nationkey, c_mktsegment""",
    bf_recommended="""
        SELECT DISTINCT c_mktsegment AS name, LENGTH(c_mktsegment) % 4 AS recommended_value
        FROM customer""",
    bf_nodes="""
        SELECT CAST(1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent_id, 'root' AS name,
            SUM(CAST(ROUND(s_acctbal*100) AS BIGINT)) AS amount
        FROM supplier
        UNION ALL
        SELECT CAST(100 + r_regionkey AS BIGINT), CAST(1 AS BIGINT), r_name, SUM(CAST(ROUND(s_acctbal*100) AS BIGINT))
        FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey
        GROUP BY r_regionkey, r_name
        UNION ALL
        SELECT CAST(1000 + n_nationkey AS BIGINT), CAST(100 + n_regionkey AS BIGINT), n_name,
            SUM(CAST(ROUND(s_acctbal*100) AS BIGINT))
        FROM nation JOIN supplier ON s_nationkey = n_nationkey
        GROUP BY n_nationkey, n_regionkey, n_name""",
    bf_indexes="""
        SELECT o_custkey AS object_id, o_orderkey AS index_id, o_orderstatus = 'P' AS is_unique,
            CASE WHEN o_orderpriority = '1-URGENT' THEN '([A] = 1)' END AS filter_definition
        FROM orders""",
    bf_index_columns="""
        SELECT o_custkey AS object_id, o_orderkey AS index_id, l_partkey % 6 + 1 AS column_id,
            MIN(l_linenumber) AS key_ordinal, MAX(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END) AS is_descending_key,
            MIN(CASE WHEN l_returnflag='N' THEN 1 ELSE 0 END) AS is_included_column
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey
        GROUP BY o_custkey, o_orderkey, l_partkey % 6 + 1""",
    bf_index_usage="""
        SELECT l_suppkey AS object_id, l_linenumber AS index_id,
            SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS user_seeks,
            SUM(CASE WHEN l_returnflag='A' AND l_discount > 0.08 THEN 1 ELSE 0 END) AS user_scans,
            SUM(CASE WHEN l_returnflag='N' AND l_discount > 0.09 THEN 1 ELSE 0 END) AS user_lookups,
            SUM(CASE WHEN l_linestatus='F' THEN 1 ELSE 0 END) AS user_updates, MAX(l_shipdate) AS last_user_seek,
            SUM(l_partkey) AS row_lock_wait_in_ms, SUM(l_suppkey) AS page_lock_wait_in_ms, COUNT(*)*100 AS page_count,
            MAX(CAST(l_quantity AS BIGINT)) AS avg_fragmentation_in_percent
        FROM lineitem
        GROUP BY l_suppkey, l_linenumber""",
    bf_foreign_keys="""
        SELECT o_custkey AS parent_object_id, o_orderkey AS constraint_object_id, o_orderpriority AS name,
            o_orderstatus = 'P' AS is_not_trusted, o_orderstatus = 'O' AS is_disabled
        FROM orders""",
    bf_identity_columns="""
        SELECT l_partkey AS object_id, CASE MIN(l_linenumber) WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 4 END AS max_length,
            SUM(CAST(l_quantity AS BIGINT)) AS last_value
        FROM lineitem
        GROUP BY l_partkey""",
    bf_stats="""
        SELECT l_partkey AS object_id, l_linenumber AS stats_id, MIN(l_shipdate) AS last_updated,
            SUM(CAST(l_quantity AS BIGINT)) AS modification_counter, COUNT(*) AS row_count
        FROM lineitem
        GROUP BY l_partkey, l_linenumber""",
    bf_partition_stats="""
        SELECT l_suppkey AS object_id, l_linenumber - 1 AS index_id, EXTRACT(YEAR
        FROM l_shipdate) - 1994 AS partition_number, COUNT(*) AS row_count, SUM(CAST(l_quantity AS BIGINT)) AS used_page_count, SUM(CAST(l_quantity AS BIGINT)) + COUNT(*) AS reserved_page_count
        FROM lineitem
        GROUP BY l_suppkey, l_linenumber - 1, EXTRACT(YEAR
        FROM l_shipdate) - 1994""",
    bf_volumes="""
        SELECT n_name AS volume_mount_point, COUNT(*)*1073741824 AS total_bytes,
            SUM(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END)*1073741824 AS available_bytes
        FROM nation JOIN customer ON c_nationkey = n_nationkey
        GROUP BY n_name""",
    bf_backupset="""
        SELECT o_custkey AS database_id, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'P' THEN 'I' ELSE 'L' END AS type,
            o_orderkey AS backup_set_id, o_orderdate AS backup_finish_date,
            CAST(ROUND(o_totalprice*100) AS BIGINT) AS backup_size, o_orderkey AS first_lsn,
            o_orderkey + o_custkey % 5 AS last_lsn
        FROM orders""",
    bf_databases="""
        SELECT c_custkey AS database_id, c_name AS name, c_mktsegment AS recovery_model_desc
        FROM customer""",
    bf_job_history="""
        SELECT user_id AS job_id, event_id AS history_id,
            CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 1 END AS run_status,
            EXTRACT(YEAR FROM ts)*10000 + EXTRACT(MONTH FROM ts)*100 + EXTRACT(DAY FROM ts) AS run_date,
            EXTRACT(HOUR FROM ts)*10000 + EXTRACT(MINUTE FROM ts)*100 AS run_time,
            CAST(FLOOR(value) AS BIGINT) % 60 + (CAST(FLOOR(value) AS BIGINT) % 50)*100 AS run_duration
        FROM events""",
    bf_job_schedules="""
        SELECT p_partkey AS schedule_id, CASE p_size % 3 WHEN 0 THEN 4 WHEN 1 THEN 8 ELSE 16 END AS freq_type,
            p_size % 127 + 1 AS freq_interval,
            CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END AS freq_subday_type,
            p_size AS freq_subday_interval, p_size % 24 * 10000 AS active_start_time
        FROM part""",
    bf_replica_states="""
        SELECT s_nationkey AS database_id, s_suppkey AS replica_id,
            CASE WHEN s_suppkey = first_key THEN 'PRIMARY' ELSE 'SECONDARY' END AS role_desc,
            CASE WHEN s_suppkey % 5 = 0 THEN 'SYNCHRONIZING' ELSE 'SYNCHRONIZED' END AS synchronization_state_desc,
            s_suppkey % 7 = 0 AS is_suspended, CAST(s_suppkey % 4 AS BIGINT) AS redo_rate,
            CAST(ABS(ROUND(s_acctbal)) AS BIGINT) AS redo_queue_size
        FROM supplier JOIN (SELECT s_nationkey AS nk, MIN(s_suppkey) AS first_key
        FROM supplier
        GROUP BY s_nationkey) f ON s_nationkey = nk""",
    bf_repl_counts="""
        SELECT n_nationkey AS article_id, COUNT(DISTINCT c_custkey) AS publisher_rows,
            COUNT(DISTINCT o_custkey) AS subscriber_rows
        FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O'
        GROUP BY n_nationkey""",
    bf_permissions="""
        SELECT DISTINCT o_custkey AS grantee_id, o_orderpriority AS permission_name, o_orderstatus AS state
        FROM orders""",
    bf_errorlog="""
        SELECT ts AS log_date, CONCAT('spid', CAST(user_id AS VARCHAR(10))) AS process_info,
            CONCAT(CASE event_type WHEN 'error' THEN 'Login failed for user ' WHEN 'view' THEN 'I/O requests taking longer than 15 seconds ' ELSE 'info ' END, CAST(event_id AS VARCHAR(20))) AS log_text
        FROM events""",
    bf_snapshots="""
        SELECT user_id AS instance_id, event_type AS metric, ts AS collected_at, event_id,
            CAST(EXTRACT(DAY FROM ts)*86400 + EXTRACT(HOUR FROM ts)*3600 + EXTRACT(MINUTE FROM ts)*60 AS BIGINT) + CAST(ROUND(value*100) AS BIGINT) * 20 AS counter_value,
            CAST(ROUND(value*100) AS BIGINT) AS gauge_value
        FROM events""",
    bf_header="""
        SELECT o_orderkey, o_custkey, o_orderdate
        FROM orders""",
    bf_detail="""
        SELECT l_orderkey, l_linenumber, l_partkey
        FROM lineitem""",
    bf_event_xml="""
        SELECT event_id, ts,
            CONCAT('<event name="', event_type, '" timestamp="', CAST(user_id AS VARCHAR(10)), '"><data name="value"><value>', CAST(CAST(ROUND(value*100) AS BIGINT) AS VARCHAR(20)), '</value></data></event>') AS event_xml
        FROM events""",
)
