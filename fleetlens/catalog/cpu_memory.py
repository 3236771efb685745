"""Processor and memory queries over the given tables."""

from fleetlens.catalog.registry import FRAMES, query, rounded
from fleetlens.operators import cpu_memory as m

R = rounded
EVENTS_AS_OF, AS_OF = "2024-01-31 00:00:00", "2001-12-01 00:00:00"

FRAMES.update(
    bf_cpu_samples="""SELECT user_id AS instance_id, ts AS event_time, event_id AS record_id, CAST(ROUND(value*100) AS BIGINT) % 101 AS process_utilization FROM events""",
    bf_cpu_requests="""
        SELECT user_id AS instance_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS collected_at, event_id AS session_id, CAST(ROUND(value*100) AS BIGINT) + EXTRACT(DAY FROM ts) * 20000 AS cpu_time FROM events""",
    bf_event_schedulers="""SELECT DISTINCT user_id AS instance_id, event_type AS scheduler_id, CASE WHEN event_type = 'error' THEN 'HIDDEN ONLINE' ELSE 'VISIBLE ONLINE' END AS status FROM events""",
    bf_schedulers="""
        SELECT c_nationkey AS instance_id, c_custkey % 300 AS scheduler_id, c_custkey % 64 AS cpu_id, c_custkey % 7 % (c_nationkey % 3 + 1) AS parent_node_id,
            CASE WHEN c_acctbal < 0 THEN 'HIDDEN ONLINE' ELSE 'VISIBLE ONLINE' END AS status, c_acctbal > 1000 AS is_online, c_custkey % 40 AS current_tasks_count,
            c_custkey % 3 AS work_queue_count, c_custkey % 5 AS runnable_tasks_count, c_custkey % 2 AS pending_disk_io_count
        FROM customer""",
    bf_sys_info="""SELECT c_nationkey AS instance_id, COUNT(*) % 60 + 1 AS hyperthread_ratio, COUNT(*) + 512 AS max_workers_count FROM customer GROUP BY c_nationkey""",
    bf_settings="""
        SELECT c_nationkey AS instance_id, 'max degree of parallelism' AS name, COUNT(*) % 20 AS value FROM customer GROUP BY c_nationkey
        UNION ALL SELECT c_nationkey AS instance_id, 'max server memory (MB)' AS name, COUNT(*) * 350 AS value FROM customer GROUP BY c_nationkey""",
    bf_sys_memory="""
        SELECT c_nationkey AS instance_id, COUNT(*) * 400000 AS total_physical_memory_kb, SUM(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) * 400000 AS available_physical_memory_kb,
            COUNT(*) * 400000 + 1000000 AS total_page_file_kb, 'Available physical memory is high' AS system_memory_state_desc
        FROM customer GROUP BY c_nationkey""",
    bf_process_memory="""
        SELECT c_nationkey AS instance_id, SUM(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) * 400000 AS physical_memory_in_use_kb, COUNT(*) % 3 = 0 AS process_physical_memory_low,
            COUNT(*) % 2 = 0 AS process_virtual_memory_low
        FROM customer GROUP BY c_nationkey""",
    bf_clerks="""SELECT counter_name AS clerk_type, cntr_value AS pages_kb FROM bf_counters""",
    bf_allocation_units="""SELECT p_partkey AS allocation_unit_id, p_partkey AS container_id FROM part""",
    bf_compressed_hobts="""SELECT h.*, CASE index_id WHEN 0 THEN 'NONE' WHEN 1 THEN 'ROW' ELSE 'PAGE' END AS data_compression_desc FROM bf_hobts h""",
    bf_buffer_files="""SELECT DISTINCT l_linenumber AS file_id, l_linenumber % 3 AS data_space_id FROM lineitem""",
    bf_filegroups="""SELECT DISTINCT l_linenumber % 3 AS data_space_id, CONCAT('fg', CAST(l_linenumber % 3 AS VARCHAR(10))) AS name FROM lineitem""",
    bf_timed_buffers="""SELECT b.*, page_id % 1000 AS read_microsec FROM bf_buffers b""",
    bf_numa_nodes="""SELECT c_custkey AS node_id, c_custkey % 50 AS memory_node_id, CASE WHEN c_custkey % 10 = 0 THEN 'ONLINE DAC' ELSE 'ONLINE' END AS node_state_desc, c_nationkey AS cpu_count FROM customer""",
    bf_deep_nodes="""SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN CAST(FLOOR(p_partkey / 2) AS BIGINT) END AS parent_id, p_name AS name, CAST(p_size * 1000 AS BIGINT) AS amount FROM part""",
    bf_numa_memory="""SELECT c_custkey AS memory_node_id, c_custkey * 5000 AS pages_kb, c_custkey * 6000 AS target_kb, c_custkey * 100 AS foreign_committed_kb FROM customer""",
    bf_resource_stats="""
        SELECT user_id AS instance_id, ts AS end_time, value AS avg_cpu_percent, value / 2 AS avg_data_io_percent, event_id AS io_bytes_read, event_id % 1000 AS io_bytes_written FROM events""",
    bf_pools="""SELECT p_partkey AS pool_id, p_name AS name, p_size AS min_memory_percent, p_partkey * 1000 AS max_memory_kb, p_partkey * 700 AS used_memory_kb FROM part""",
    bf_topology="""SELECT o_orderkey AS instance_id, o_custkey % 4 + 1 AS socket_count, o_custkey % 16 + 1 AS cores_per_socket, o_orderdate AS start_time FROM orders""",
    bf_clean_counters="""
        SELECT CASE object_name WHEN 'SQLServer:Buffer Node' THEN 'Memory Node' ELSE 'Memory Manager' END AS object_name,
            REPLACE(counter_name, ' (KB)', '') AS counter_name, instance_name, cntr_value, counter_name AS raw_name
        FROM bf_counters WHERE counter_name <> 'Number of Deadlocks/sec'""",
)


@query("m2_cpu_recent_averages", """
    WITH r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY instance_id ORDER BY event_time DESC, record_id DESC) AS n FROM bf_cpu_samples)
    SELECT instance_id, CAST(SUM(process_utilization) FILTER (n <= 5) // COUNT(*) FILTER (n <= 5) AS BIGINT) AS avg_5, CAST(SUM(process_utilization) FILTER (n <= 10) // COUNT(*) FILTER (n <= 10) AS BIGINT) AS avg_10,
        CAST(SUM(process_utilization) FILTER (n <= 15) // COUNT(*) FILTER (n <= 15) AS BIGINT) AS avg_15, CAST(SUM(process_utilization) FILTER (n <= 30) // COUNT(*) FILTER (n <= 30) AS BIGINT) AS avg_30
    FROM r WHERE n <= 30 GROUP BY instance_id""")
def _(t):
    return m.cpu_recent_averages(t.cpu_samples, order=("-event_time", "-record_id"))


@query("m3_cpu_percent_between", f"""
    WITH s AS (SELECT instance_id, collected_at, SUM(cpu_time) AS cpu FROM bf_cpu_requests GROUP BY 1, 2),
    p AS (SELECT *, LAG(cpu) OVER w AS pc, LAG(collected_at) OVER w AS pt FROM s WINDOW w AS (PARTITION BY instance_id ORDER BY collected_at)),
    n AS (SELECT instance_id, COUNT(*) AS cpus FROM bf_event_schedulers WHERE status = 'VISIBLE ONLINE' GROUP BY 1),
    d AS (SELECT p.*, cpus, CASE WHEN cpu >= pc THEN cpu - pc END AS used, DATE_DIFF('millisecond', pt, collected_at) AS ms FROM p JOIN n ON p.instance_id = n.instance_id)
    SELECT instance_id, collected_at, cpus, CAST(used AS BIGINT) AS cpu_ms, {R('used', '(cpus * ms)', 2, 100)} AS cpu_percent FROM d""")
def _(t):
    return m.cpu_percent_between(t.cpu_requests, t.event_schedulers)


@query("m4_memory_tree", f"""
    WITH a AS (SELECT id, CAST(NULL AS BIGINT) AS parent_id, name, amount, 0 AS level, name AS label, CAST(NULL AS DOUBLE) AS share_of_parent, CAST(NULL AS DOUBLE) AS share_of_root FROM bf_nodes WHERE parent_id IS NULL),
    b AS (SELECT n.id, n.parent_id, n.name, n.amount, 1 AS level, '|···' || n.name AS label, COALESCE({R('n.amount', 'a.amount', 4)}, 0.0) AS share_of_parent, CAST(NULL AS DOUBLE) AS share_of_root, a.amount AS ra
        FROM bf_nodes n JOIN a ON n.parent_id = a.id),
    c AS (SELECT n.id, n.parent_id, n.name, n.amount, 2 AS level, '      |···' || n.name AS label, COALESCE({R('n.amount', 'b.amount', 4)}, 0.0) AS share_of_parent,
        COALESCE({R('n.amount', 'b.ra', 4)}, 0.0) AS share_of_root FROM bf_nodes n JOIN b ON n.parent_id = b.id)
    SELECT id, parent_id, name, CAST(amount AS BIGINT) AS amount, level, label, share_of_parent, share_of_root FROM
        (SELECT * FROM a UNION ALL SELECT * EXCLUDE (ra) FROM b UNION ALL SELECT * FROM c)""")
def _(t):
    return m.memory_tree(t.nodes)


@query("m4_memory_tree_deep", f"""
    WITH RECURSIVE d AS (
        SELECT id, parent_id, name, amount, 0 AS level, name AS label, CAST(NULL AS DOUBLE) AS share_of_parent, CAST(NULL AS DOUBLE) AS share_of_root, amount AS ra FROM bf_deep_nodes WHERE parent_id IS NULL
        UNION ALL SELECT n.id, n.parent_id, n.name, n.amount, d.level + 1, REPEAT('      ', d.level) || '|···' || n.name, COALESCE({R('n.amount', 'd.amount', 4)}, 0.0),
            CASE WHEN d.level >= 1 THEN COALESCE({R('n.amount', 'd.ra', 4)}, 0.0) END, d.ra FROM bf_deep_nodes n JOIN d ON n.parent_id = d.id)
    SELECT id, parent_id, name, amount, level, label, share_of_parent, share_of_root FROM d""")
def _(t):
    return m.memory_tree(t.deep_nodes)


@query("m5_normalise_counters", f"""
    SELECT object_name, counter_name, instance_name, CAST(cntr_value AS BIGINT) AS cntr_value,
        CASE WHEN raw_name LIKE '%(KB)' THEN {R('cntr_value', '1024', 2)} ELSE CAST(cntr_value AS DOUBLE) END AS formatted_value, SPLIT_PART(raw_name, ' ', 1) AS short_name FROM bf_clean_counters""")
def _(t):
    return m.normalise_counters(t.counters)


@query("m6_page_life_check", f"""
    SELECT p.counter_name || ' (Node: ' || p.instance_name || ')' AS counter, CAST(p.cntr_value AS BIGINT) AS value,
        GREATEST(300, CAST(CEIL({R('d.cntr_value', '1024', 2)} * 5 / 4096) * 60 AS BIGINT)) AS recommended_minimum
    FROM bf_clean_counters p LEFT JOIN bf_clean_counters d ON d.counter_name = 'Database Cache Memory' AND d.instance_name = p.instance_name WHERE p.counter_name = 'Page life expectancy'""")
def _(t):
    return m.page_life_check(m.normalise_counters(t.counters))


@query("m7_counter_filter", """
    SELECT counter_name, object_name, instance_name, CAST(cntr_value AS BIGINT) AS cntr_value FROM bf_counters
    WHERE object_name LIKE '%Memory Manager%' AND (counter_name LIKE '%Target Server Memory%' OR counter_name LIKE '%Total Server Memory%')""")
def _(t):
    return m.counter_filter(t.counters)


@query("m8_counter_pivot", f"""
    SELECT CAST(SUM(cntr_value) FILTER (counter_name = 'Total Server Memory (KB)') AS BIGINT) AS "Total Server Memory (KB)",
        CAST(SUM(cntr_value) FILTER (counter_name = 'Database Cache Memory (KB)') AS BIGINT) AS "Database Cache Memory (KB)",
        {R("SUM(cntr_value) FILTER (counter_name = 'Database Cache Memory (KB)')", "SUM(cntr_value) FILTER (counter_name = 'Total Server Memory (KB)')", 2, 100)} AS percent_free
    FROM bf_counters WHERE cntr_value > 0""")
def _(t):
    names = ("Total Server Memory (KB)", "Database Cache Memory (KB)")
    return m.counter_pivot(t.counters, names, free=names[1], total=names[0])


@query("m8_memory_summary", f"""
    WITH c AS (SELECT MAX(cntr_value) FILTER (counter_name = 'Target Server Memory (KB)') AS g, MAX(cntr_value) FILTER (counter_name = 'Total Server Memory (KB)') AS t,
        MAX(cntr_value) FILTER (counter_name = 'Page life expectancy') AS p FROM bf_counters)
    SELECT {R('g', '1048576', 3)} AS target_gb, {R('t', '1048576', 3)} AS total_gb, CAST(p AS BIGINT) AS ple_s, {R('t', '(p * 1024)', 2)} AS churn_mb_s,
        CASE WHEN t < g THEN 'below target: memory is still being taken, or there is no more to take' ELSE 'target reached' END AS target_vs_total FROM c""")
def _(t):
    return m.memory_summary(t.counters)


@query("m9_memory_clerks_top", f"""
    SELECT clerk_type, {R('SUM(pages_kb)', '1024', 2)} AS memory_mb FROM bf_clerks GROUP BY clerk_type ORDER BY SUM(pages_kb) DESC, clerk_type LIMIT 3""")
def _(t):
    return m.memory_clerks_top(t.clerks, 3)


@query("m10_buffer_share_by_database", f"""
    WITH b AS (SELECT database_id, COUNT(*) AS n, SUM(free_space_in_bytes) AS f, AVG(read_microsec) AS avg_read_microsec FROM bf_timed_buffers GROUP BY 1)
    SELECT ROW_NUMBER() OVER (ORDER BY n DESC, database_id) AS buffer_rank, database_id, n AS page_count, {R('(n * 8)', '1024', 2)} AS cached_mb, {R('n', 'SUM(n) OVER ()', 2, 100)} AS cached_pct,
        CAST(f // 1048576 AS BIGINT) AS free_mb, avg_read_microsec FROM b""")
def _(t):
    return m.buffer_share_by_database(t.timed_buffers)


@query("m11_buffer_by_object", f"""
    SELECT fg.name AS filegroup_name, h.object_id, o.name AS object_name, h.index_id, data_compression_desc, COUNT(*) AS buffer_count, {R('COUNT(*)', '128', 2)} AS buffer_mb
    FROM bf_buffers b JOIN bf_allocation_units a ON b.allocation_unit_id = a.allocation_unit_id JOIN bf_compressed_hobts h ON h.hobt_id = a.container_id
    JOIN bf_part_objects o ON h.object_id = o.object_id JOIN bf_buffer_files f ON f.file_id = b.file_id JOIN bf_filegroups fg ON fg.data_space_id = f.data_space_id GROUP BY ALL""")
def _(t):
    return m.buffer_by_object(t.buffers, t.allocation_units, t.compressed_hobts, t.part_objects, t.buffer_files, t.filegroups)


@query("m12_os_memory", f"""
    SELECT s.instance_id, total_physical_memory_kb // 1024 AS physical_mb, CAST(available_physical_memory_kb // 1024 AS BIGINT) AS available_mb, total_page_file_kb // 1024 AS page_file_mb,
        total_page_file_kb // 1024 - total_physical_memory_kb // 1024 AS physical_page_file_mb, CAST(physical_memory_in_use_kb // 1024 AS BIGINT) AS process_mb,
        {R('(total_physical_memory_kb - available_physical_memory_kb)', 'total_physical_memory_kb', 2, 100)} AS used_pct, system_memory_state_desc,
        CASE WHEN process_physical_memory_low AND process_virtual_memory_low THEN 'Physical and Virtual memory low!' WHEN process_physical_memory_low THEN 'Physical memory low!'
            WHEN process_virtual_memory_low THEN 'Virtual memory low!' END AS low_memory_alert
    FROM bf_sys_memory s JOIN bf_process_memory p ON s.instance_id = p.instance_id""")
def _(t):
    return m.os_memory(t.sys_memory, t.process_memory)


@query("m14_numa_balance", """
    WITH n AS (SELECT instance_id, parent_node_id, COUNT(*) AS cores, SUM(CASE WHEN is_online THEN 1 ELSE 0 END) AS online, MIN(cpu_id) AS first_cpu FROM bf_schedulers WHERE status LIKE 'VISIBLE%' GROUP BY 1, 2),
    p AS (SELECT instance_id, COUNT(*) AS numa_nodes, SUM(cores) AS t, SUM(online) AS o, MIN(online) = MAX(online) AS balanced, SUM(online) // COUNT(*) AS c FROM n GROUP BY 1),
    s AS (SELECT n.instance_id, STRING_AGG(CAST(first_cpu AS VARCHAR) || ' TO ' || CAST(CAST(first_cpu + c - 1 AS BIGINT) AS VARCHAR), ', ' ORDER BY parent_node_id) AS spans FROM n JOIN p ON n.instance_id = p.instance_id GROUP BY 1)
    SELECT p.instance_id, numa_nodes, CAST(t AS BIGINT) AS total_cores, CAST(o AS BIGINT) AS online_cores, balanced, CAST(c AS BIGINT) AS cores_per_node, CASE WHEN t = o THEN 'AUTO' ELSE spans END AS affinity
    FROM p JOIN s ON p.instance_id = s.instance_id""")
def _(t):
    return m.numa_balance(t.schedulers)


@query("m14_numa_nodes", f"""
    SELECT node_id, n.memory_node_id, node_state_desc, cpu_count, pages_kb // 1024 AS committed_mb, target_kb // 1024 AS target_mb, {R('foreign_committed_kb', '1024', 2)} AS foreign_mb
    FROM bf_numa_nodes n JOIN bf_numa_memory m ON n.memory_node_id = m.memory_node_id WHERE node_state_desc <> 'ONLINE DAC'""")
def _(t):
    return m.numa_nodes(t.numa_nodes, t.numa_memory)


@query("m15_scheduler_load", """
    WITH s AS (SELECT instance_id, CAST(SUM(current_tasks_count) // COUNT(*) AS BIGINT) AS avg_tasks, CAST(SUM(work_queue_count) // COUNT(*) AS BIGINT) AS avg_work_queue,
        CAST(SUM(runnable_tasks_count) // COUNT(*) AS BIGINT) AS avg_runnable, CAST(SUM(pending_disk_io_count) // COUNT(*) AS BIGINT) AS avg_pending_io FROM bf_schedulers WHERE scheduler_id < 255 GROUP BY 1)
    SELECT *, avg_tasks > 10 AS many_tasks, avg_runnable > 1 AS cpu_pressure, avg_pending_io > 1 AS io_pressure FROM s""")
def _(t):
    return m.scheduler_load(t.schedulers)


@query("m16_maxdop_advice", """
    WITH n AS (SELECT instance_id, parent_node_id, COUNT(*) AS cpus, SUM(CASE WHEN is_online THEN 1 ELSE 0 END) AS online FROM bf_schedulers GROUP BY 1, 2),
    f AS (SELECT n.instance_id, COUNT(*) AS nn, CAST(SUM(cpus) AS BIGINT) AS cc, CAST(SUM(online) AS BIGINT) AS oc, CAST(MAX(online) AS BIGINT) AS pn FROM n GROUP BY 1),
    g AS (SELECT f.*, value AS cur, hyperthread_ratio AS hr, CASE WHEN value = 0 THEN oc ELSE value END AS eff, CASE WHEN nn = 1 THEN 8 ELSE 16 END AS lim, cc // nn AS share
        FROM f JOIN bf_settings s ON s.instance_id = f.instance_id AND name = 'max degree of parallelism' JOIN bf_sys_info i ON i.instance_id = f.instance_id)
    SELECT instance_id, nn AS numa_nodes, cc AS cpu_count, oc AS online_count, pn AS per_node, cur AS current_maxdop,
        CAST(CASE WHEN eff = 1 THEN CASE WHEN pn <= lim THEN pn WHEN pn // 2 <= lim THEN pn // 2 ELSE lim END WHEN pn <= lim AND eff > pn THEN pn WHEN pn > lim AND nn = 1 THEN 8 WHEN pn > lim THEN 16 END AS BIGINT) AS threshold_maxdop,
        CASE WHEN eff = 1 THEN '1 rules out parallel plans' WHEN pn <= lim AND eff > pn THEN 'more than a node has processors'
            WHEN pn > lim AND nn = 1 THEN 'one large node: 8 is enough' WHEN pn > lim THEN 'more than 16' END AS threshold_message,
        CAST(CASE WHEN cc < 8 AND cc <= hr THEN cc WHEN cc >= 8 AND cc <= hr THEN 8 WHEN cc >= 8 THEN pn // (cc // hr) END AS BIGINT) AS kin_maxdop,
        CAST(CASE WHEN cur > oc THEN oc WHEN nn = 1 AND oc > 8 AND (cur = 0 OR cur > 8) THEN 8 WHEN nn > 1 AND share < 8 AND (cur = 0 OR cur > share) THEN share
            WHEN nn > 1 AND share >= 8 AND (cur = 0 OR cur > 8 OR cur > share) THEN 8 END AS BIGINT) AS check_maxdop,
        CASE WHEN cur > oc THEN 'more than the processors in use' WHEN nn = 1 AND oc > 8 AND (cur = 0 OR cur > 8) THEN 'not the advised value for so many processors'
            WHEN nn > 1 AND ((share < 8 AND (cur = 0 OR cur > share)) OR (share >= 8 AND (cur = 0 OR cur > 8 OR cur > share))) THEN 'not the advised value for so many processors a node' END AS check_deviation
    FROM g""")
def _(t):
    return m.maxdop_advice(t.schedulers, t.sys_info, t.settings)


@query("m17_max_memory_advice", """
    WITH s AS (SELECT instance_id, parent_node_id, MAX(CASE WHEN is_online THEN 1 ELSE 0 END) AS o FROM bf_schedulers WHERE scheduler_id < 255 GROUP BY 1, 2),
    n AS (SELECT instance_id, COUNT(*) AS numa_nodes, CAST(SUM(o) AS BIGINT) AS numa_nodes_affined FROM s GROUP BY 1),
    f AS (SELECT m.instance_id, total_physical_memory_kb // 1024 AS system_mb, max_workers_count, value AS max_memory_mb, numa_nodes, numa_nodes_affined
        FROM bf_sys_memory m JOIN bf_sys_info i ON m.instance_id = i.instance_id JOIN bf_settings c ON m.instance_id = c.instance_id AND name = 'max server memory (MB)' JOIN n ON m.instance_id = n.instance_id),
    g AS (SELECT *, CAST(CASE WHEN system_mb <= 2048 THEN 512 WHEN system_mb <= 4096 THEN 819 WHEN system_mb <= 8192 THEN 1228 WHEN system_mb <= 12288 THEN 2048 WHEN system_mb <= 24576 THEN 2560
        WHEN system_mb <= 32768 THEN 3072 ELSE 4096 END AS BIGINT) AS os_reserve_mb FROM f),
    h AS (SELECT *, system_mb - os_reserve_mb - (max_workers_count * 2 - 256) AS recommended_mb FROM g)
    SELECT *, CAST(CASE WHEN numa_nodes > 1 THEN TRUNC(recommended_mb / numa_nodes) * numa_nodes_affined ELSE recommended_mb END AS BIGINT) AS recommended_for_nodes_mb,
        CASE WHEN max_memory_mb > system_mb THEN 'limit above what the host has'
            WHEN numa_nodes > 1 AND (max_memory_mb // numa_nodes) * numa_nodes_affined > (system_mb // numa_nodes) * numa_nodes_affined THEN 'limit takes memory of other nodes'
            WHEN numa_nodes <= 1 AND max_memory_mb BETWEEN recommended_mb AND system_mb THEN 'limit leaves the host too little' END AS alert
    FROM h""")
def _(t):
    return m.max_memory_advice(t.sys_memory, t.sys_info, t.settings, t.schedulers)


@query("m18_resource_usage", f"""
    SELECT instance_id, {R('SUM(CAST(ROUND(avg_cpu_percent * 100) AS BIGINT))', '(COUNT(*) * 100)', 2)} AS avg_cpu_percent, MAX(avg_cpu_percent) AS max_cpu_percent,
        {R('SUM(CAST(ROUND(avg_data_io_percent * 100) AS BIGINT))', '(COUNT(*) * 100)', 2)} AS avg_data_io_percent, MAX(avg_data_io_percent) AS max_data_io_percent
    FROM bf_resource_stats WHERE end_time >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 15 DAY GROUP BY 1""")
def _(t):
    return m.resource_usage(t.resource_stats, EVENTS_AS_OF, 15, ("avg_cpu_percent", "avg_data_io_percent"))


@query("m18_resource_io_share", f"""
    SELECT instance_id, end_time, {R('io_bytes_read', '1048576', 2)} AS mb_read, {R('io_bytes_read', '(io_bytes_read + io_bytes_written)', 2, 100)} AS read_pct,
        {R('io_bytes_written', '1048576', 2)} AS mb_written, {R('io_bytes_written', '(io_bytes_read + io_bytes_written)', 2, 100)} AS write_pct, {R('(io_bytes_read + io_bytes_written)', '1048576', 2)} AS mb_total
    FROM bf_resource_stats WHERE io_bytes_read > 0 AND io_bytes_written > 0""")
def _(t):
    return m.resource_io_share(t.resource_stats)


@query("m19_resource_pools", """
    SELECT pool_id, name, min_memory_percent, max_memory_kb // 1024 AS max_memory_mb, used_memory_kb // 1024 AS used_memory_mb FROM bf_pools""")
def _(t):
    return m.resource_pools(t.pools)


@query("m20_cpu_topology_inventory", f"""
    SELECT *, socket_count * cores_per_socket AS physical_cores, DATE_DIFF('hour', start_time, TIMESTAMP '{AS_OF}') AS uptime_hours FROM bf_topology""")
def _(t):
    return m.cpu_topology_inventory(t.topology, AS_OF)
