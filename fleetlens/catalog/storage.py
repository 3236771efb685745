"""Storage queries over the given tables."""

from fleetlens.catalog.registry import FRAMES, query, rounded
from fleetlens.operators import storage as c

R = rounded

FRAMES.update(
    bf_space_files="""
        SELECT p_partkey % 200 AS database_id, p_partkey AS file_id, p_name AS name, CONCAT(CASE WHEN p_size % 2 = 0 THEN 'c:' ELSE 'd:' END, CHR(92), p_brand, CHR(92), 'f', CAST(p_partkey AS VARCHAR(10))) AS physical_name,
            p_size % 2 AS type, p_size * 100000 + p_partkey AS size, p_size % 7 * 128 AS growth, p_size % 3 = 0 AS is_percent_growth, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN -1 ELSE p_size * 131072 END AS max_size,
            p_size % 3 AS data_space_id
        FROM part""",
    bf_used_pages="""SELECT p_partkey % 200 AS database_id, p_partkey AS file_id, p_size * 40000 AS used_pages FROM part""",
    bf_usage_units="""
        SELECT l_suppkey AS database_id, l_partkey AS container_id, l_linenumber % 3 + 1 AS type, CAST(l_quantity AS BIGINT) + 2 AS total_pages, CAST(l_quantity AS BIGINT) AS used_pages,
            CAST(l_quantity AS BIGINT) - 1 AS data_pages FROM lineitem""",
    bf_usage_partitions="""SELECT p_partkey AS partition_id, p_partkey % 300 AS object_id, p_size % 3 AS index_id FROM part""",
    bf_internal_types="""SELECT p_partkey AS object_id, 200 + p_size % 6 AS internal_type FROM part""",
    bf_log_counters="""
        SELECT n_name AS instance_name, 'Log File(s) Size (KB)  ' AS counter_name, COUNT(*) * 1000 AS cntr_value FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name
        UNION ALL SELECT n_name, 'Log File(s) Used Size (KB)', SUM(CASE WHEN c_acctbal > 2000 THEN 1 ELSE 0 END) * 1000 FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""",
    bf_nation_databases="""SELECT n_nationkey AS database_id, n_name AS name, CASE n_regionkey WHEN 0 THEN 'FULL' ELSE 'SIMPLE' END AS recovery_model_desc FROM nation""",
    bf_log_usage="""
        SELECT c_nationkey AS database_id, SUM(c_custkey) * 100000 AS total_log_size_in_bytes, SUM(c_custkey % 1000) * 10000 AS used_log_space_in_bytes, COUNT(*) * 50000 AS log_space_in_bytes_since_last_backup
        FROM customer GROUP BY c_nationkey""",
    bf_log_info="""
        SELECT l_suppkey AS database_id, l_linenumber AS file_id, l_orderkey AS vlf_sequence_number, l_partkey AS vlf_begin_offset, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS vlf_size_bytes, l_returnflag = 'A' AS vlf_active
        FROM lineitem""",
    bf_log_stats="""SELECT l_suppkey AS database_id, COUNT(*) AS vlf_count FROM lineitem GROUP BY l_suppkey""",
    bf_log_files="""SELECT s_suppkey AS database_id, CONCAT(s_name, '_log') AS name, 1 AS type, s_suppkey * 13000 + 2000 AS size FROM supplier""",
    bf_member_files="""
        SELECT c_nationkey AS instance_id, 2 AS database_id, c_custkey AS file_id, 0 AS type, CASE WHEN c_nationkey % 2 = 0 THEN 1000 ELSE 1000 + c_custkey % 2 * 500 END AS size FROM customer""",
    bf_tempdb_usage="""
        SELECT p_partkey % 5 AS file_id, p_size AS unallocated_extent_page_count, p_size % 7 AS internal_object_reserved_page_count, p_size % 11 AS user_object_reserved_page_count,
            p_size % 13 AS version_store_reserved_page_count, p_size % 2 AS mixed_extent_page_count FROM part""",
    bf_sequences="""SELECT p_partkey AS object_id, p_partkey AS current_value, 2100 AS maximum_value, p_size % 5 = 0 AS is_cycling FROM part""",
)


def _size(x):
    def one(f, u):
        return f"LPAD(FORMAT('{{:,.2f}}', {R(x, str(f), 2)}), 7, ' ') || ' {u}'"
    return f"CASE WHEN {x} >= {1 << 40} THEN {one(1 << 40, 'TB')} WHEN {x} >= {1 << 30} THEN {one(1 << 30, 'GB')} WHEN {x} >= {1 << 20} THEN {one(1 << 20, 'MB')} ELSE {one(1 << 10, 'KB')} END"


@query("c1_volume_space", f"""
    WITH v AS (SELECT volume_mount_point, MAX(total_bytes) AS t, CAST(MAX(available_bytes) AS BIGINT) AS a FROM bf_volumes GROUP BY 1)
    SELECT volume_mount_point, {R('t', str(1 << 30), 2)} AS total_gb, {R('a', str(1 << 30), 2)} AS free_gb, {R('a', 't', 2, 100)} AS free_pct, {_size('t')} AS capacity, {_size('(t - a)')} AS used_space,
        {_size('a')} AS free_space, REPEAT('█', (t - a) * 50 // t) || REPEAT('▒', (a * 50 + t - 1) // t) AS chart,
        CASE WHEN a // 1048576 < 20480 THEN 'Volume has only ' || CAST(a // 1048576 AS VARCHAR) || ' MB free space' WHEN {R('a', 't', 2, 100)} < 48 THEN 'Volume has only ' || CAST({R('a', 't', 2, 100)} AS VARCHAR) || ' % free space' END AS alert
    FROM v""")
def _(t):
    return c.volume_space(t.volumes, 20480, 48)


@query("c2_file_space", f"""
    SELECT f.database_id, f.file_id, f.name, g.name AS filegroup_name, {R('size', '128', 2)} AS size_mb, {R('used_pages', '128', 2)} AS used_mb, {R('(size - used_pages)', '128', 2)} AS free_mb,
        {R('(size - used_pages)', 'size', 2, 100)} AS free_pct, 'By ' || CASE WHEN is_percent_growth THEN CAST(growth AS VARCHAR) || '% -' ELSE CAST(growth // 128 AS VARCHAR) || ' MB -' END
        || CASE max_size WHEN 0 THEN 'DISABLED' WHEN -1 THEN ' Unrestricted' ELSE ' Restricted to ' || CAST(max_size // 131072 AS VARCHAR) || ' GB' END
        || CASE WHEN is_percent_growth THEN ' [steps become larger with the file]' ELSE '' END AS auto_growth
    FROM bf_space_files f JOIN bf_used_pages u ON f.database_id = u.database_id AND f.file_id = u.file_id LEFT JOIN bf_filegroups g ON g.data_space_id = f.data_space_id""")
def _(t):
    return c.file_space(t.space_files, t.used_pages, t.filegroups)


_USAGE = """
    WITH s AS (SELECT database_id, SUM(CASE WHEN type = 1 THEN 0 ELSE size END) AS db, SUM(CASE WHEN type = 1 THEN size ELSE 0 END) AS lg FROM bf_files GROUP BY 1),
    u AS (SELECT a.database_id, SUM(total_pages) AS rp, SUM(used_pages) AS up, SUM(CASE WHEN i.internal_type IN (202, 204) THEN 0 WHEN a.type <> 1 THEN used_pages WHEN p.index_id < 2 THEN data_pages ELSE 0 END) AS dp
        FROM bf_usage_units a JOIN bf_usage_partitions p ON a.container_id = p.partition_id LEFT JOIN bf_internal_types i ON i.object_id = p.object_id GROUP BY 1),
    b AS (SELECT s.database_id, db, lg, rp, up, dp, GREATEST(db - rp, 0) AS fr FROM s JOIN u ON s.database_id = u.database_id)"""
_USAGE_OUT = f"""SELECT database_id, {R('(db + lg)', '128', 4)} AS database_size_mb, {R('rp', '128', 4)} AS reserved_mb, {R('dp', '128', 4)} AS data_mb, {R('lg', '128', 4)} AS log_size_mb, {R('(up - dp)', '128', 4)} AS index_mb,
        {R('(rp - up)', '128', 4)} AS unused_mb, {R('fr', '128', 4)} AS unallocated_mb, {R('fr', '(rp + fr)', 4, 100)} AS unallocated_pct, {R('dp', '(rp + fr)', 4, 100)} AS data_pct,
        {R('(up - dp)', '(rp + fr)', 4, 100)} AS index_pct, {R('(rp - up)', '(rp + fr)', 4, 100)} AS unused_pct"""


@query("c3_database_usage", f"{_USAGE} {_USAGE_OUT} FROM b")
def _(t):
    return c.database_usage(t.files, t.usage_units, t.usage_partitions, t.internal_types)


@query("c3_fleet_usage", f"""{_USAGE}, r AS (SELECT database_id, SUM(db) AS db, SUM(lg) AS lg, SUM(rp) AS rp, SUM(up) AS up, SUM(dp) AS dp, SUM(fr) AS fr FROM b GROUP BY ROLLUP (database_id)) {_USAGE_OUT} FROM r""")
def _(t):
    return c.database_usage(t.files, t.usage_units, t.usage_partitions, t.internal_types, totals=True)


@query("c4_log_space", f"""
    WITH s AS (SELECT instance_name, MAX(CASE WHEN counter_name LIKE 'Log File(s) Size%' THEN cntr_value END) AS z, MAX(CASE WHEN counter_name LIKE 'Log File(s) Used%' THEN cntr_value END) AS u FROM bf_log_counters GROUP BY 1)
    SELECT d.*, {R('z', '1024', 2)} AS log_size_mb, {R('u', '1024', 2)} AS log_used_mb, ROUND({R('u', 'z', 2)} * 100) AS log_used_pct FROM bf_nation_databases d JOIN s ON d.name = s.instance_name WHERE z > 0""")
def _(t):
    return c.log_space(t.log_counters, t.nation_databases)


@query("c4_log_space_usage", f"""
    SELECT d.*, {R('total_log_size_in_bytes', '1048576', 2)} AS total_mb, {R('used_log_space_in_bytes', '1048576', 2)} AS used_mb, {R('log_space_in_bytes_since_last_backup', '1048576', 2)} AS since_backup_mb,
        {R('used_log_space_in_bytes', 'total_log_size_in_bytes', 2, 100)} AS used_pct FROM bf_log_usage u JOIN bf_nation_databases d ON u.database_id = d.database_id""")
def _(t):
    return c.log_space_usage(t.log_usage, t.nation_databases)


@query("c5_vlf_counts", f"""
    SELECT database_id, file_id, COUNT(*) AS vlf_count, {R('SUM(vlf_size_bytes)', '1048576', 2)} AS vlf_mb, COUNT(*) FILTER (vlf_active) AS active_count,
        {R('SUM(CASE WHEN vlf_active THEN vlf_size_bytes ELSE 0 END)', '1048576', 2)} AS active_mb, COUNT(*) FILTER (NOT vlf_active) AS inactive_count,
        {R('SUM(CASE WHEN vlf_active THEN 0 ELSE vlf_size_bytes END)', '1048576', 2)} AS inactive_mb FROM bf_log_info GROUP BY 1, 2""")
def _(t):
    return c.vlf_counts(t.log_info)


@query("c6_last_vlf", """
    SELECT * EXCLUDE (rn) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY database_id ORDER BY vlf_sequence_number DESC, file_id DESC, vlf_begin_offset DESC, vlf_size_bytes DESC, vlf_active DESC) AS rn FROM bf_log_info) WHERE rn = 1""")
def _(t):
    return c.last_vlf(t.log_info)


@query("c7_vlf_target", """
    WITH m AS (SELECT s.database_id, vlf_count, name, size // 128 AS mb FROM bf_log_stats s JOIN bf_log_files f ON s.database_id = f.database_id),
    n AS (SELECT *, CASE WHEN mb <= 64 THEN 64 WHEN mb < 256 THEN 256 WHEN mb < 1024 THEN 512 WHEN mb < 4096 THEN 1024 WHEN mb < 8192 THEN 2048 WHEN mb < 16384 THEN 4096 ELSE 8192 END AS step FROM m),
    i AS (SELECT *, CASE WHEN mb <= 64 THEN 1 ELSE NULLIF(CAST(ROUND(ROUND(mb, -2) / step) AS BIGINT), 0) END AS it FROM n),
    p AS (SELECT *, it * step AS pot, it * CASE WHEN it * step <= 64 THEN 4 WHEN it * step < 1024 THEN 8 ELSE 16 END AS pc FROM i)
    SELECT database_id, vlf_count, name, mb AS log_size_mb, it AS iterations, pot AS potential_size_mb, pc AS potential_vlf_count, 'MODIFY FILE ( NAME = N''' || name || ''', SIZE = ' || CAST(pot AS VARCHAR) || 'MB );' AS remediation
    FROM p WHERE vlf_count > 100 AND vlf_count > pc""")
def _(t):
    return c.vlf_target(t.log_stats, t.log_files, 15, 100)


_NEXT = "CAST(CASE WHEN is_percent_growth THEN size * 8 * growth // 100 ELSE growth * 8 END AS BIGINT) AS next_growth_kb"


@query("c8_file_growth_findings", f"""
    SELECT database_id, file_id, physical_name, {_NEXT}, 'cannot grow' AS finding FROM bf_space_files WHERE growth = 0
    UNION ALL SELECT database_id, file_id, physical_name, {_NEXT}, 'grows by a share of its size' FROM bf_space_files WHERE is_percent_growth AND growth > 0
    UNION ALL SELECT database_id, file_id, physical_name, {_NEXT}, 'lies on the system volume' FROM bf_space_files WHERE physical_name LIKE 'c:%' AND (database_id > 3 OR database_id = 2)
    UNION ALL SELECT database_id, file_id, physical_name, {_NEXT}, 'temporary files of one database grow by different steps' FROM bf_space_files WHERE database_id = 2 AND type = 0
        AND (SELECT COUNT(*) FROM (SELECT DISTINCT growth, is_percent_growth FROM bf_space_files WHERE database_id = 2 AND type = 0)) > 1""")
def _(t):
    return c.file_growth_findings(t.space_files)


@query("c9_tempdb_files_check", f"""
    WITH f AS (SELECT instance_id, COUNT(*) AS n, COUNT(DISTINCT size) AS z, {R('(SUM(size) * 8)', '1024', 2)} AS mb FROM bf_member_files GROUP BY 1),
    s AS (SELECT instance_id, COUNT(*) AS cc, COUNT(*) FILTER (is_online) AS oc FROM bf_schedulers WHERE scheduler_id < 255 GROUP BY 1)
    SELECT f.instance_id, n AS file_count, z AS sizes, mb AS size_mb, cc AS cpu_count, oc AS online_count,
        CASE WHEN z = 1 AND n % 4 = 0 AND (n BETWEEN 4 AND 8 OR (n >= oc // 2 AND n >= 8)) THEN '[OK]'
            WHEN n < 4 THEN 'only ' || CAST(n AS VARCHAR) || ' temporary data file(s); 4 to 8 of one size are usual'
            WHEN z = 1 AND n < oc // 2 AND n >= 8 AND n % 4 = 0 THEN 'few files for the processors; one for every two of them, in fours and of one size, is usual'
            WHEN z > 1 AND n % 4 > 0 THEN 'unequal sizes, and not in fours' WHEN z = 1 AND n % 4 > 0 THEN 'not in fours'
            WHEN z > 1 AND n % 4 = 0 THEN 'unequal sizes' ELSE '[OK]' END AS deviation,
        CASE WHEN n < cc THEN 'Yes' WHEN cc < 8 THEN 'No' ELSE 'only if contention goes on' END AS change_required
    FROM f JOIN s ON f.instance_id = s.instance_id""")
def _(t):
    return c.tempdb_files_check(t.member_files, t.schedulers)


@query("c10_tempdb_space", f"""
    SELECT {R('(SUM(unallocated_extent_page_count) * 8)', '1024', 2)} AS free_mb, {R('(SUM(internal_object_reserved_page_count) * 8)', '1024', 2)} AS internal_mb, {R('(SUM(user_object_reserved_page_count) * 8)', '1024', 2)} AS user_mb,
        {R('(SUM(version_store_reserved_page_count) * 8)', '1024', 2)} AS version_store_mb, {R('(SUM(mixed_extent_page_count) * 8)', '1024', 2)} AS mixed_mb,
        {R('(SUM(internal_object_reserved_page_count + user_object_reserved_page_count + version_store_reserved_page_count) * 8)', '1024', 2)} AS used_mb FROM bf_tempdb_usage""")
def _(t):
    return c.tempdb_space(t.tempdb_usage)


@query("c11_identity_exhaustion", f"""
    WITH a AS (SELECT object_id, 'identity' AS kind, CAST(last_value AS BIGINT) AS last_value, CASE max_length WHEN 1 THEN 256 WHEN 2 THEN 32767 ELSE 2147483647 END AS mx FROM bf_identity_columns
        UNION ALL SELECT object_id, 'sequence', current_value, maximum_value FROM bf_sequences WHERE NOT is_cycling)
    SELECT object_id, kind, last_value, {R('last_value', 'mx', 2, 100)} AS percent_used, CAST(mx AS DOUBLE) AS max_value FROM a WHERE {R('last_value', 'mx', 2, 100)} >= 80""")
def _(t):
    return c.identity_exhaustion(t.identity_columns, t.sequences)
