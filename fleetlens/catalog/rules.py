"""Configuration, integrity, log and security queries over the given tables."""

from fleetlens.catalog.registry import FRAMES, query, rounded
from fleetlens.operators import amplify as g, backup, health as h, rules as r, security as s, storage

R = rounded
AS_OF, EVENTS_AS_OF = "2001-12-01 00:00:00", "2024-01-31 00:00:00"

FRAMES.update(
    bf_pair_settings="""
        SELECT c_nationkey AS instance_id, 'affinity mask' AS name, COUNT(*) % 4 AS value FROM customer GROUP BY c_nationkey
        UNION ALL SELECT c_nationkey, 'affinity I/O mask', COUNT(*) % 3 FROM customer GROUP BY c_nationkey UNION ALL SELECT c_nationkey, 'blocked process threshold (s)', COUNT(*) % 8 FROM customer GROUP BY c_nationkey
        UNION ALL SELECT c_nationkey, 'min memory per query (KB)', COUNT(*) % 50 FROM customer GROUP BY c_nationkey UNION ALL SELECT c_nationkey, 'index create memory (KB)', COUNT(*) % 30 FROM customer GROUP BY c_nationkey
        UNION ALL SELECT c_nationkey, 'max worker threads', COUNT(*) * 35 FROM customer GROUP BY c_nationkey""",
    bf_properties="""SELECT instance_id, metric AS property, collected_at, event_id, gauge_value AS value FROM bf_snapshots""",
    bf_db_settings="""
        SELECT c_custkey AS database_id, c_name AS name, CASE WHEN c_custkey % 23 = 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc, c_custkey % 7 = 0 AS is_auto_close_on, c_custkey % 11 = 0 AS is_auto_shrink_on,
            c_custkey % 13 <> 0 AS is_auto_create_stats_on, c_custkey % 17 <> 0 AS is_auto_update_stats_on, CASE c_custkey % 9 WHEN 0 THEN 'NONE' WHEN 1 THEN 'TORN_PAGE_DETECTION' ELSE 'CHECKSUM' END AS page_verify_option_desc,
            CASE WHEN c_custkey % 5 = 0 THEN 130 ELSE 150 END AS compatibility_level, c_custkey % 80 AS owner_sid FROM customer""",
    bf_scoped="""
        SELECT c_nationkey AS instance_id, CONCAT('db', CAST(c_custkey % (c_nationkey + 1) AS VARCHAR(10))) AS database_name, CASE c_custkey % 3 WHEN 0 THEN 'ELEVATE_ONLINE' WHEN 1 THEN 'ELEVATE_RESUMABLE' ELSE 'MAXDOP' END AS name,
            CASE WHEN c_custkey % 4 < c_nationkey % 4 THEN 'OFF' ELSE 'ON' END AS value, c_custkey AS setting_id FROM customer""",
    bf_dbinfo="""
        SELECT event_id AS row_id, CASE event_type WHEN 'error' THEN 'DatabaseName' WHEN 'click' THEN 'dbi_dbccLastKnownGood' WHEN 'view' THEN 'dbi_DBCCFlags' ELSE 'other' END AS field,
            CASE event_type WHEN 'error' THEN CONCAT('db', CAST(user_id AS VARCHAR(10))) WHEN 'click' THEN CONCAT('2024-01-', CASE WHEN EXTRACT(DAY FROM ts) < 10 THEN '0' ELSE '' END, CAST(EXTRACT(DAY FROM ts) AS VARCHAR(10)), ' 00:00:00')
                WHEN 'view' THEN CAST(user_id % 2 AS VARCHAR(10)) ELSE 'x' END AS value
        FROM events""",
    bf_suspect_pages="""SELECT event_id AS page_id, user_id AS database_id, event_id % 4 AS file_id, event_id % 6 AS event_type, event_id % 50 AS error_count, ts AS last_update_date FROM events""",
    bf_checks="""SELECT o_custkey AS parent_object_id, o_orderkey AS constraint_object_id, o_orderpriority AS name, o_orderkey % 5 = 0 AS is_not_trusted, o_orderkey % 2 = 0 AS is_disabled FROM orders""",
    bf_dumps="""SELECT CONCAT('dump', CAST(o_orderkey AS VARCHAR(20)), '.mdmp') AS filename, o_orderdate AS creation_time FROM orders""",
    bf_mail_events="""SELECT event_id AS mailitem_id, event_type, ts AS log_date, CONCAT('mail ', event_type) AS description FROM events""",
    bf_log_archives="""SELECT event_type AS log_kind, event_id AS archive_no, CAST(ROUND(value * 100) AS BIGINT) * 200000 AS size_bytes FROM events""",
    bf_store_options="""
        SELECT c_name AS database_name, c_custkey % 4 AS query_capture_mode, c_custkey % 2 AS size_based_cleanup_mode, CASE c_custkey % 3 WHEN 0 THEN 'READ_ONLY' ELSE 'READ_WRITE' END AS actual_state_desc,
            'READ_WRITE' AS desired_state_desc FROM customer""",
    bf_secondary_databases="""SELECT c_name AS database_name FROM customer WHERE c_acctbal < 0""",
    bf_server_principals="""SELECT c_nationkey AS instance_id, CASE WHEN c_custkey % 60 = 0 THEN '0x01' ELSE c_name END AS sid, CASE WHEN c_custkey % 60 = 0 THEN 'sa' ELSE c_name END AS name, c_acctbal < 5000 AS is_disabled FROM customer""",
    bf_instance_settings="""
        SELECT instance_id, name, value FROM bf_pair_settings UNION ALL SELECT c_nationkey, 'allow updates', COUNT(*) % 2 FROM customer GROUP BY c_nationkey
        UNION ALL SELECT c_nationkey, 'xp_cmdshell', COUNT(*) % 3 FROM customer GROUP BY c_nationkey UNION ALL SELECT c_nationkey, 'network packet size (B)', 4096 + COUNT(*) % 2 FROM customer GROUP BY c_nationkey
        UNION ALL SELECT c_nationkey, 'remote admin connections', COUNT(*) % 2 FROM customer GROUP BY c_nationkey""",
    bf_facts="""
        SELECT n_nationkey AS instance_id, CASE WHEN n_nationkey % 2 = 0 THEN '1433' ELSE '51433' END AS tcp_port, n_nationkey % 4 AS audit_level, n_nationkey % 3 > 0 AS agent_running,
            CASE WHEN n_nationkey % 6 = 0 THEN 'Express' ELSE 'Enterprise' END AS edition, n_name AS server_name, CASE WHEN n_nationkey % 7 = 0 THEN 'other' ELSE n_name END AS actual_server_name FROM nation""",
    bf_users="""SELECT c_custkey AS user_id, c_name AS name, c_custkey % 200 AS sid, CASE WHEN c_custkey % 10 = 0 THEN 'NONE' ELSE 'INSTANCE' END AS authentication_type_desc FROM customer""",
    bf_user_logins="""SELECT c_custkey AS sid, c_name AS name FROM customer WHERE c_custkey % 3 = 0""",
    bf_schemas="""SELECT o_custkey % 50 AS database_id, 16380 + o_orderkey % 100 AS object_id, CASE o_orderkey % 5 WHEN 0 THEN 'smart_admin' WHEN 1 THEN 'SentryOne' ELSE o_orderpriority END AS name, o_custkey % 6 AS owner_id FROM orders""",
    bf_owner_roles="""SELECT p_partkey % 50 AS database_id, 16380 + p_partkey AS object_id, p_name AS name, p_size % 4 AS owner_id FROM part""",
    bf_owned_databases="""SELECT s_suppkey % 9 AS database_id, s_suppkey AS row_id, s_name AS name, s_suppkey % 3 AS owner_id, CASE WHEN s_suppkey % 4 = 0 THEN '0x01' ELSE '0x9' END AS owner_sid FROM supplier""",
    bf_owner_principals="""SELECT DISTINCT o_custkey % 50 AS database_id, o_custkey % 5 AS principal_id, CASE o_custkey % 5 WHEN 1 THEN 'dbo' WHEN 2 THEN '1-URGENT' ELSE 'owner' END AS name FROM orders""",
    bf_db_users="""SELECT c_custkey AS principal_id, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'R' WHEN 1 THEN 'S' WHEN 2 THEN 'U' ELSE 'G' END AS type FROM customer""",
    bf_role_members="""SELECT o_custkey - o_custkey % 4 AS role_id, o_custkey AS member_id FROM orders WHERE o_custkey % 4 > 0""",
    bf_grants="""
        SELECT o_orderkey % 4 AS class, o_orderkey % 300 AS major_id, o_orderkey % 7 AS minor_id, o_custkey AS grantee_id, o_orderpriority AS permission_name, CASE o_orderstatus WHEN 'P' THEN 'W' ELSE 'G' END AS state,
            CASE o_orderstatus WHEN 'P' THEN 'GRANT_WITH_GRANT_OPTION' ELSE 'GRANT' END AS state_desc FROM orders""",
    bf_grant_objects="""SELECT p_partkey AS object_id, p_type AS schema_name, p_name AS name FROM part""",
    bf_grant_columns="""SELECT p_partkey AS object_id, 3 AS column_id, p_brand AS name FROM part""",
    bf_grant_schemas="""SELECT s_suppkey AS schema_id, s_name AS name FROM supplier""",
    bf_linked_servers="""SELECT s_suppkey AS server_id, s_name AS name, s_suppkey % 3 > 0 AS is_data_access_enabled, s_suppkey % 4 = 0 AS is_distributor FROM supplier""",
    bf_linked_logins="""SELECT o_custkey % 100 AS server_id, o_orderkey % 3 AS local_principal_id, o_orderkey % 5 > 0 AS uses_self_credential FROM orders""",
)


@query("r1_run_rules", """
    SELECT 'Database Backup' AS category, 'Never backed up' AS sub_category, name AS object_name, 'No backup was found' AS details FROM bf_databases WHERE database_id NOT IN (SELECT database_id FROM bf_backupset)
    UNION ALL SELECT 'General', 'cannot grow', physical_name, 'let it grow, up to a maximum' FROM bf_space_files WHERE growth = 0
    UNION ALL SELECT 'Automation', 'Query Store', database_name, 'captures queries and never removes any' FROM bf_store_options WHERE query_capture_mode <> 3 AND size_based_cleanup_mode <> 1
    UNION ALL SELECT 'Automation', 'Query Store state', database_name, 'wanted: ' || desired_state_desc || ', is: ' || actual_state_desc FROM bf_store_options
        WHERE desired_state_desc <> actual_state_desc AND database_name NOT IN (SELECT database_name FROM bf_secondary_databases)""")
def _(t):
    never = backup.stale_backups(t.databases, t.backupset, AS_OF).where("age_hours = 9999").join(t.databases.select("database_id", "name"), "database_id")
    fixed = storage.file_growth_findings(t.space_files).where("finding = 'cannot grow'")
    return r.run_rules([
        r.finding(never, "Database Backup", "Never backed up", "name", "No backup was found"),
        r.finding(fixed, "General", "cannot grow", "physical_name", "let it grow, up to a maximum"),
        r.query_store_findings(t.store_options, t.secondary_databases),
    ])


_SETTINGS = ", ".join(f"('{n}', {v}, '{m.replace(chr(39), chr(39) * 2)}', {sec})" for rows, sec in ((r.RECOMMENDED, "false"), (r.SECURITY_RECOMMENDED, "true")) for n, v, m in rows)


@query("r1_health_check", f"""
    WITH o AS (SELECT * FROM bf_db_settings WHERE state_desc = 'ONLINE'),
    b AS (SELECT database_id, MAX(backup_finish_date) AS last_backup, MAX(backup_finish_date) FILTER (type = 'L') AS last_log FROM bf_backupset GROUP BY 1),
    w AS (SELECT instance_id, MAX(value) FILTER (name = 'affinity mask') AS a, MAX(value) FILTER (name = 'affinity I/O mask') AS i, MAX(value) FILTER (name = 'blocked process threshold (s)') AS b,
        MAX(value) FILTER (name = 'min memory per query (KB)') AS q, MAX(value) FILTER (name = 'index create memory (KB)') AS x, MAX(value) FILTER (name = 'max worker threads') AS t FROM bf_instance_settings GROUP BY 1),
    l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY log_kind ORDER BY archive_no) AS rn FROM bf_log_archives),
    unkeyed AS (
        SELECT 'General' AS category, 'closes when idle' AS sub_category, name AS object_name, 'every reopening costs time and empties its caches; switch it off' AS details FROM o WHERE is_auto_close_on
        UNION ALL SELECT 'Performance', 'shrinks by itself', name, 'shrinking fragments indexes and files grow again; switch it off' FROM o WHERE is_auto_shrink_on
        UNION ALL SELECT 'Performance', 'no statistics are made on demand', name, 'plans lack row estimates; switch it on' FROM o WHERE NOT is_auto_create_stats_on
        UNION ALL SELECT 'Performance', 'statistics are not refreshed', name, 'plans use old row estimates; switch it on' FROM o WHERE NOT is_auto_update_stats_on
        UNION ALL SELECT 'General', 'pages are not verified by checksum', name, 'verified by: ' || page_verify_option_desc FROM o WHERE page_verify_option_desc <> 'CHECKSUM'
        UNION ALL SELECT 'Compatibility', 'database level ' || CAST(compatibility_level AS VARCHAR) || ', instance level 150', name, 'behaves like another version than the instance' FROM bf_db_settings WHERE compatibility_level <> 150
        UNION ALL SELECT 'General', 'not online', name, 'state: ' || state_desc FROM bf_db_settings WHERE state_desc <> 'ONLINE'
        UNION ALL SELECT 'General', 'owner unknown', name, 'no login has the owner''s id, as after a restore from elsewhere; name an owner that exists' FROM bf_db_settings WHERE owner_sid NOT IN (SELECT sid FROM bf_logins)
        UNION ALL SELECT 'Database Backup', 'never backed up', name, 'there is no backup of any kind' FROM bf_db_settings WHERE database_id NOT IN (SELECT database_id FROM b)
        UNION ALL SELECT 'Database Backup', 'log backup overdue', name, 'the last one ended at ' || STRFTIME(last_log, '%Y-%m-%d %H:%M:%S') FROM bf_db_settings d JOIN b ON b.database_id = d.database_id WHERE last_log < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
        UNION ALL SELECT 'General', 'cannot grow', physical_name, 'let it grow, up to a maximum' FROM bf_space_files WHERE growth = 0
        UNION ALL SELECT 'Performance', 'grows by a share of its size', physical_name, 'by ' || CAST(growth AS VARCHAR) || ' percent' FROM bf_space_files WHERE is_percent_growth AND growth > 0
        UNION ALL SELECT 'General', 'lies on the system volume', physical_name, 'when it fills that volume, the system stops too' FROM bf_space_files WHERE physical_name LIKE 'c:%' AND (database_id > 3 OR database_id = 2)
        UNION ALL SELECT 'Performance', 'temporary files grow by different steps', physical_name, 'they are filled in proportion only while they are equal' FROM bf_space_files WHERE database_id = 2 AND type = 0
            AND (SELECT COUNT(*) FROM (SELECT DISTINCT growth, is_percent_growth FROM bf_space_files WHERE database_id = 2 AND type = 0)) > 1
        UNION ALL SELECT 'Automation', 'Query Store', database_name, 'captures queries and never removes any' FROM bf_store_options WHERE query_capture_mode <> 3 AND size_based_cleanup_mode <> 1
        UNION ALL SELECT 'Automation', 'Query Store state', database_name, 'wanted: ' || desired_state_desc || ', is: ' || actual_state_desc FROM bf_store_options
            WHERE desired_state_desc <> actual_state_desc AND database_name NOT IN (SELECT database_name FROM bf_secondary_databases)
        UNION ALL SELECT 'Integrity', 'suspect page', CONCAT(database_id, ':', file_id, ':', page_id), CASE event_type WHEN 1 THEN 'Error 823 or unspecified Error 824' WHEN 2 THEN 'Bad Checksum' ELSE 'Torn Page' END
            || ', ' || CAST(error_count AS VARCHAR) || ' times, last at ' || STRFTIME(last_update_date, '%Y-%m-%d %H:%M:%S') FROM bf_suspect_pages WHERE event_type IN (1, 2, 3)
        UNION ALL SELECT 'Integrity', 'foreign key not trusted', name, 'constraint ' || CAST(constraint_object_id AS VARCHAR) || ' may be violated by old rows; check it again' FROM bf_foreign_keys WHERE is_not_trusted AND NOT is_disabled
        UNION ALL SELECT 'Integrity', 'check constraint not trusted', name, 'constraint ' || CAST(constraint_object_id AS VARCHAR) || ' may be violated by old rows; check it again' FROM bf_checks WHERE is_not_trusted AND NOT is_disabled
        UNION ALL SELECT 'Instance Health', 'crash dump', filename, 'written at ' || STRFTIME(creation_time, '%Y-%m-%d %H:%M:%S') || ' | details: ' || REPLACE(filename, '.mdmp', '.txt') FROM bf_dumps
        UNION ALL SELECT 'Automation', 'mail failed', 'mail ' || CAST(mailitem_id AS VARCHAR), 'reason: ' || description FROM bf_mail_events WHERE event_type = 'error' AND log_date >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 3600 MINUTE
        UNION ALL SELECT 'Performance', 'error log too large', log_kind || ' has ' || CAST({R('size_bytes', '1048576', 2)} AS VARCHAR) || ' MB.', 'start a new log from time to time' FROM l WHERE rn = 1 AND {R('size_bytes', '1048576', 2)} > 100),
    keyed AS (
        SELECT instance_id, 'Performance' AS category, 'contradicting settings' AS sub_category, 'affinity mask' AS object_name, 'some processors are assigned to queries and to I/O at once' AS details FROM w WHERE a & i <> 0
        UNION ALL SELECT instance_id, 'Performance', 'contradicting settings', 'blocked process threshold (s)', 'a blocking report every 1 to 4 seconds is too frequent; use 0 or at least 5' FROM w WHERE b BETWEEN 1 AND 4
        UNION ALL SELECT instance_id, 'Performance', 'contradicting settings', 'index create memory (KB)', 'building an index may take less memory than any query gets' FROM w WHERE x > 0 AND x < q
        UNION ALL SELECT instance_id, 'Performance', 'contradicting settings', 'max worker threads', 'more than 2048 workers on 64 bits' FROM w WHERE t > 2048
        UNION ALL SELECT instance_id, CASE WHEN sec THEN 'Security' ELSE 'General' END, CASE WHEN sec THEN 'exposed instance setting' ELSE 'unusual instance setting' END, c.name,
            m || ' (current value: ' || CAST(value AS VARCHAR) || ', recommended value: ' || CAST(v AS VARCHAR) || ')' FROM bf_instance_settings c JOIN (VALUES {_SETTINGS}) r(name, v, m, sec) ON c.name = r.name WHERE value <> v
        UNION ALL SELECT instance_id, 'Security', 'exposed instance setting', 'TCPIP Port', 'listens on the well-known port' FROM bf_facts WHERE tcp_port = '1433'
        UNION ALL SELECT instance_id, 'Security', 'exposed instance setting', 'Failed Logins Auditing', 'rejected logins leave no trace' FROM bf_facts WHERE audit_level NOT IN (2, 3)
        UNION ALL SELECT instance_id, 'Security', 'exposed instance setting', 'SA login', 'the built-in administrator can log in under its known name' FROM bf_server_principals WHERE sid = '0x01' AND name = 'sa' AND NOT is_disabled
        UNION ALL SELECT instance_id, 'Automation', 'Agent Service', 'no agent', 'nothing scheduled runs and no alert is raised until it is started' FROM bf_facts WHERE NOT agent_running AND edition NOT LIKE 'Express%'
        UNION ALL SELECT instance_id, 'General', 'registered under another name', server_name, 'the machine''s name: ' || actual_server_name FROM bf_facts WHERE server_name <> actual_server_name)
    SELECT CAST(NULL AS BIGINT) AS instance_id, * FROM unkeyed UNION ALL SELECT CAST(instance_id AS BIGINT), category, sub_category, object_name, details FROM keyed""")
def _(t):
    found = h.compile_rules({
        "databases": h.database_source(t.db_settings, t.logins, t.backupset, AS_OF), "files": h.file_source(t.space_files), "settings": h.settings_source(t.instance_settings),
        "facts": t.facts, "principals": t.server_principals, "stores": h.store_source(t.store_options, t.secondary_databases), "suspect_pages": h.page_source(t.suspect_pages),
        "foreign_keys": t.foreign_keys, "checks": t.checks, "dumps": t.dumps, "mail": h.mail_source(t.mail_events, EVENTS_AS_OF, 3600), "logs": h.log_source(t.log_archives)})
    return found.withColumn("instance_id", found["instance_id"].cast("bigint"))


@query("r2_config_drift", """
    SELECT instance_id, c.name, value, recommended_value, 'differs from the recommendation (current value: ' || CAST(value AS VARCHAR) || ', recommended value: ' || CAST(recommended_value AS VARCHAR) || ')' AS details
    FROM bf_config c JOIN (SELECT name, CAST(recommended_value AS INTEGER) AS recommended_value FROM bf_recommended) r ON c.name = r.name WHERE value <> recommended_value""")
def _(t):
    return r.config_drift(t.config, t.recommended)


@query("r2_config_pair_findings", """
    WITH w AS (SELECT instance_id, MAX(value) FILTER (name = 'affinity mask') AS a, MAX(value) FILTER (name = 'affinity I/O mask') AS i, MAX(value) FILTER (name = 'blocked process threshold (s)') AS b,
        MAX(value) FILTER (name = 'min memory per query (KB)') AS q, MAX(value) FILTER (name = 'index create memory (KB)') AS x, MAX(value) FILTER (name = 'max worker threads') AS t FROM bf_pair_settings GROUP BY 1)
    SELECT instance_id, 'some processors are assigned to queries and to I/O at once' AS details FROM w WHERE a & i <> 0
    UNION ALL SELECT instance_id, 'a blocking report every 1 to 4 seconds is too frequent; use 0 or at least 5' FROM w WHERE b > 0 AND b < 5
    UNION ALL SELECT instance_id, 'building an index may take less memory than any query gets' FROM w WHERE x > 0 AND x < q
    UNION ALL SELECT instance_id, 'more than 2048 workers on 64 bits' FROM w WHERE t > 2048""")
def _(t):
    return r.config_pair_findings(t.pair_settings)


@query("r3_fleet_config_diff", """
    WITH v AS (SELECT name, value, COUNT(*) AS n FROM bf_config GROUP BY 1, 2),
    m AS (SELECT name, value AS majority_value, COUNT(*) OVER (PARTITION BY name) AS distinct_values, ROW_NUMBER() OVER (PARTITION BY name ORDER BY n DESC, value) AS rn FROM v)
    SELECT instance_id, c.name, value, majority_value, distinct_values FROM bf_config c JOIN m ON c.name = m.name AND rn = 1 WHERE distinct_values > 1 AND value <> majority_value""")
def _(t):
    return r.fleet_config_diff(t.config)


@query("r4_server_inventory", """
    WITH l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY instance_id, property ORDER BY collected_at DESC, event_id DESC) AS rn FROM bf_properties)
    SELECT instance_id, MAX(value) FILTER (property = 'view') AS view, MAX(value) FILTER (property = 'click') AS click, MAX(value) FILTER (property = 'error') AS error FROM l WHERE rn = 1 GROUP BY 1""")
def _(t):
    return r.server_inventory(t.properties, ("-collected_at", "-event_id"), wide=("view", "click", "error"))


@query("r5_database_findings", """
    WITH o AS (SELECT * FROM bf_db_settings WHERE state_desc = 'ONLINE')
    SELECT 'General' AS category, 'closes when idle' AS sub_category, name AS object_name, 'every reopening costs time and empties its caches; switch it off' AS details FROM o WHERE is_auto_close_on
    UNION ALL SELECT 'Performance', 'shrinks by itself', name, 'shrinking fragments indexes and files grow again; switch it off' FROM o WHERE is_auto_shrink_on
    UNION ALL SELECT 'Performance', 'no statistics are made on demand', name, 'plans lack row estimates; switch it on' FROM o WHERE NOT is_auto_create_stats_on
    UNION ALL SELECT 'Performance', 'statistics are not refreshed', name, 'plans use old row estimates; switch it on' FROM o WHERE NOT is_auto_update_stats_on
    UNION ALL SELECT 'General', 'pages are not verified by checksum', name, 'verified by: ' || page_verify_option_desc FROM o WHERE page_verify_option_desc <> 'CHECKSUM'
    UNION ALL SELECT 'Compatibility', 'database level ' || CAST(compatibility_level AS VARCHAR) || ', instance level 150', name, 'behaves like another version than the instance'
        FROM bf_db_settings WHERE compatibility_level <> 150
    UNION ALL SELECT 'General', 'not online', name, 'state: ' || state_desc FROM bf_db_settings WHERE state_desc <> 'ONLINE'
    UNION ALL SELECT 'General', 'owner unknown', name, 'no login has the owner''s id, as after a restore from elsewhere; name an owner that exists' FROM bf_db_settings
        WHERE owner_sid NOT IN (SELECT sid FROM bf_logins)""")
def _(t):
    return r.database_findings(t.db_settings, t.logins)


@query("r6_scoped_config_off", """
    WITH o AS (SELECT * FROM bf_scoped WHERE name LIKE 'ELEVATE%' AND value = 'OFF'), n AS (SELECT instance_id, COUNT(*) AS n, COUNT(DISTINCT database_name) AS d FROM o GROUP BY 1)
    SELECT o.instance_id, 'database: [' || database_name || ']: switched off for this database: ' || name AS message, CAST(1 AS BIGINT) AS row_count FROM o JOIN n ON o.instance_id = n.instance_id WHERE n <= 10
    UNION ALL SELECT o.instance_id, 'database: [' || database_name || '], has ' || CAST(COUNT(*) AS VARCHAR) || ' such settings switched off', COUNT(*) FROM o JOIN n ON o.instance_id = n.instance_id
        WHERE n > 10 AND d <= 10 GROUP BY o.instance_id, database_name
    UNION ALL SELECT instance_id, 'there are ' || CAST(d AS VARCHAR) || ' databases that have such settings switched off', n FROM n WHERE n > 10 AND d > 10""")
def _(t):
    return r.scoped_config_off(t.scoped)


@query("r7_integrity_check_age", f"""
    WITH n AS (SELECT *, FIRST_VALUE(CASE WHEN field = 'DatabaseName' THEN value END IGNORE NULLS) OVER (ORDER BY row_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS database_name FROM bf_dbinfo)
    SELECT row_id, database_name, 'last integrity check without errors: ' || value AS details FROM n WHERE field = 'dbi_dbccLastKnownGood' AND TRY_CAST(value AS TIMESTAMP) < TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY
    UNION ALL SELECT row_id, database_name, 'column values were never checked; run a full integrity check' FROM n WHERE field = 'dbi_DBCCFlags' AND value = '0' AND database_name IS NOT NULL""")
def _(t):
    return r.integrity_check_age(t.dbinfo, EVENTS_AS_OF, rows_per_range=500)


@query("r8_suspect_pages", """
    SELECT database_id, file_id, page_id, CASE event_type WHEN 1 THEN 'Error 823 or unspecified Error 824' WHEN 2 THEN 'Bad Checksum' WHEN 3 THEN 'Torn Page' END || ' (Count: ' || CAST(error_count AS VARCHAR) || ', Last Update: '
        || STRFTIME(last_update_date, '%Y-%m-%d %H:%M:%S') || ')' AS details FROM bf_suspect_pages WHERE event_type IN (1, 2, 3)""")
def _(t):
    return r.suspect_pages(t.suspect_pages)


@query("r9_untrusted_constraints", """
    SELECT parent_object_id, constraint_object_id, name, 'Untrusted Foreign Key(s)' AS finding FROM bf_foreign_keys WHERE is_not_trusted AND NOT is_disabled
    UNION ALL SELECT parent_object_id, constraint_object_id, name, 'Untrusted Check Constraint(s)' FROM bf_checks WHERE is_not_trusted AND NOT is_disabled""")
def _(t):
    return r.untrusted_constraints(t.foreign_keys, t.checks)


@query("r10_orphaned_users", """
    SELECT *, CASE WHEN name IN (SELECT name FROM bf_user_logins) THEN 'a login of that name exists' ELSE 'no login of that name' END AS details FROM bf_users
    WHERE authentication_type_desc = 'INSTANCE' AND sid NOT IN (SELECT sid FROM bf_user_logins)""")
def _(t):
    return s.orphaned_users(t.users, t.user_logins)


def _owner(kind, expected):
    return f"database_id, '{kind}::[' || name || ']' AS object_name, owner_name, {expected} AS owner_should_be, 'ALTER AUTHORIZATION ON {kind}::[' || name || '] TO [' || {expected} || '];' AS fix"


@query("r11_invalid_owners", f"""
    WITH p AS (SELECT database_id, principal_id, name AS owner_name FROM bf_owner_principals),
    a AS (SELECT s.*, owner_name FROM bf_schemas s LEFT JOIN p ON p.database_id = s.database_id AND p.principal_id = s.owner_id WHERE object_id >= 16384 AND name NOT IN ('SQLSentry', 'SentryOne')),
    b AS (SELECT s.*, owner_name FROM bf_owner_roles s LEFT JOIN p ON p.database_id = s.database_id AND p.principal_id = s.owner_id WHERE object_id >= 16384),
    d AS (SELECT s.*, owner_name FROM bf_owned_databases s LEFT JOIN p ON p.database_id = s.database_id AND p.principal_id = s.owner_id WHERE s.database_id <= 4)
    SELECT {_owner('SCHEMA', 'name')} FROM a WHERE owner_name IS NULL OR (name <> 'smart_admin' AND name <> owner_name) OR (name = 'smart_admin' AND owner_id <> 1)
    UNION ALL SELECT {_owner('ROLE', "'dbo'")} FROM b WHERE owner_name IS NULL OR owner_id <> 1 UNION ALL SELECT {_owner('DATABASE', "'sa'")} FROM d WHERE owner_name IS NULL OR owner_sid <> '0x01'""")
def _(t):
    return s.invalid_owners(t.schemas, t.owner_roles, t.owned_databases, t.owner_principals)


def _permissions(drop):
    verb = "'REVOKE'" if drop else "CASE WHEN state <> 'W' THEN state_desc ELSE 'GRANT' END"
    to = f"' {'FROM' if drop else 'TO'} [' || u.name || ']'" + ("" if drop else " || CASE WHEN state <> 'W' THEN '' ELSE ' WITH GRANT OPTION' END")
    people = "'DROP USER [' || name || '];'" if drop else "'CREATE USER [' || name || '] FOR LOGIN [' || name || '];'"
    return f"""
        WITH u AS (SELECT * FROM bf_db_users WHERE type <> 'R')
        SELECT 1 AS section, 'USE [db]' AS statement UNION SELECT 4, {people} FROM u
        UNION SELECT 6, 'ALTER ROLE [' || r.name || '] {'DROP' if drop else 'ADD'} MEMBER [' || u.name || '];' FROM bf_role_members m JOIN bf_db_users r ON r.principal_id = m.role_id JOIN u ON u.principal_id = m.member_id WHERE u.principal_id > 4
        UNION SELECT 9, {verb} || ' ' || permission_name || ' ON [' || schema_name || '].[' || o.name || ']' || COALESCE('([' || c.name || '])', '') || {to} FROM bf_grants g JOIN u ON u.principal_id = g.grantee_id
            JOIN bf_grant_objects o ON o.object_id = g.major_id LEFT JOIN bf_grant_columns c ON c.object_id = g.major_id AND c.column_id = g.minor_id WHERE class = 1
        UNION SELECT 12, {verb} || ' ' || permission_name || {to} FROM bf_grants g JOIN u ON u.principal_id = g.grantee_id WHERE class = 0 AND u.principal_id > 4
        UNION SELECT 15, {verb} || ' ' || permission_name || ' ON SCHEMA::[' || x.name || ']' || {to} FROM bf_grants g JOIN u ON u.principal_id = g.grantee_id JOIN bf_grant_schemas x ON x.schema_id = g.major_id WHERE class = 3"""


@query("r12_permission_export", _permissions(False))
def _(t):
    return s.permission_export(t.db_users, t.role_members, t.grants, t.grant_objects, t.grant_columns, t.grant_schemas)


@query("r12_permission_drop", _permissions(True))
def _(t):
    return s.permission_export(t.db_users, t.role_members, t.grants, t.grant_objects, t.grant_columns, t.grant_schemas, drop=True)


@query("r13_linked_server_exposure", """
    SELECT server_id, name, 'open to every login' AS details FROM bf_linked_servers WHERE server_id <> 0 AND (is_data_access_enabled OR NOT is_distributor)
        AND server_id IN (SELECT server_id FROM bf_linked_logins WHERE local_principal_id = 0 AND NOT uses_self_credential)""")
def _(t):
    return s.linked_server_exposure(t.linked_servers, t.linked_logins)


@query("r14_login_failure_burst", f"""
    WITH h AS (SELECT * FROM bf_errorlog WHERE log_date > TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 3600 MINUTE AND log_text LIKE '%Login failed%') SELECT * FROM h WHERE (SELECT COUNT(*) FROM h) >= 10""")
def _(t):
    return r.login_failure_burst(t.errorlog, EVENTS_AS_OF, 3600, 10)


@query("r15_errorlog_search", "SELECT * FROM bf_errorlog WHERE REGEXP_MATCHES(log_text, 'user .*7') OR REGEXP_MATCHES(log_text, '15 seconds') ORDER BY log_date DESC, process_info, log_text LIMIT 1000")
def _(t):
    return r.errorlog_search(t.errorlog, ["user .*7", "15 seconds"])


@query("r16_file_findings", f"""
    WITH l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY log_kind ORDER BY archive_no) AS rn FROM bf_log_archives)
    SELECT 'Instance Health' AS category, 'crash dump' AS sub_category, filename AS object_name, 'written at ' || STRFTIME(creation_time, '%Y-%m-%d %H:%M:%S') || ' | details: ' || REPLACE(filename, '.mdmp', '.txt') AS details FROM bf_dumps
    UNION ALL SELECT 'Automation', 'mail failed', 'mail ' || CAST(mailitem_id AS VARCHAR), 'reason: ' || description FROM bf_mail_events WHERE event_type = 'error' AND log_date >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 3600 MINUTE
    UNION ALL SELECT 'Performance', 'error log too large', log_kind || ' has ' || CAST({R('size_bytes', '1048576', 2)} AS VARCHAR) || ' MB.', 'start a new log from time to time' FROM l WHERE rn = 1 AND {R('size_bytes', '1048576', 2)} > 100""")
def _(t):
    return r.file_findings(t.dumps, t.mail_events, t.log_archives, EVENTS_AS_OF, 3600)


@query("r17_query_store_findings", """
    SELECT 'Automation' AS category, 'Query Store' AS sub_category, database_name AS object_name, 'captures queries and never removes any' AS details FROM bf_store_options WHERE query_capture_mode <> 3 AND size_based_cleanup_mode <> 1
    UNION ALL SELECT 'Automation', 'Query Store state', database_name, 'wanted: ' || desired_state_desc || ', is: ' || actual_state_desc FROM bf_store_options
        WHERE desired_state_desc <> actual_state_desc AND database_name NOT IN (SELECT database_name FROM bf_secondary_databases)""")
def _(t):
    return r.query_store_findings(t.store_options, t.secondary_databases)


_SEC = "'Security' AS category, 'exposed instance setting' AS sub_category"


@query("r18_security_findings", f"""
    SELECT instance_id, {_SEC}, 'TCPIP Port' AS object_name, 'listens on the well-known port' AS details FROM bf_facts WHERE tcp_port = '1433'
    UNION ALL SELECT instance_id, {_SEC}, 'Failed Logins Auditing', 'rejected logins leave no trace' FROM bf_facts WHERE audit_level NOT IN (2, 3)
    UNION ALL SELECT instance_id, {_SEC}, 'SA login', 'the built-in administrator can log in under its known name' FROM bf_server_principals WHERE sid = '0x01' AND name = 'sa' AND NOT is_disabled
    UNION ALL SELECT instance_id, 'Automation', 'Agent Service', 'no agent', 'nothing scheduled runs and no alert is raised until it is started' FROM bf_facts WHERE NOT agent_running AND edition NOT LIKE 'Express%'
    UNION ALL SELECT instance_id, 'General', 'registered under another name', server_name, 'the machine''s name: ' || actual_server_name FROM bf_facts WHERE server_name <> actual_server_name
    UNION ALL SELECT instance_id, {_SEC}, c.name, 'differs from the recommendation (current value: ' || CAST(value AS VARCHAR) || ', recommended value: ' || CAST(recommended_value AS VARCHAR) || ')'
        FROM bf_config c JOIN bf_recommended r ON c.name = r.name WHERE value <> recommended_value""")
def _(t):
    return r.security_findings(t.config, t.server_principals, t.facts, t.recommended)


_SHIFTS = g.day_shifts(8)
_COPIES = "(VALUES " + ", ".join(f"({i}, {d})" for i, d in enumerate(_SHIFTS)) + ") AS v(i, d)"


@query("g1_amplify_header", f"""
    SELECT o_orderkey * 8 + i AS new_o_orderkey, o_orderkey, o_custkey, o_orderdate + TO_DAYS(d) AS o_orderdate, d AS shift_days FROM bf_header, {_COPIES}""")
def _(t):
    return g.amplify_header(t.header, "o_orderkey", ["o_orderdate"], _SHIFTS)


@query("g1_amplify_detail", f"""
    SELECT l_orderkey * 8 + i AS new_l_orderkey, l_orderkey, l_linenumber, l_partkey FROM bf_detail, {_COPIES} WHERE l_orderkey IN (SELECT o_orderkey FROM bf_header)""")
def _(t):
    return g.amplify_detail(t.detail, t.header, "l_orderkey", "o_orderkey", _SHIFTS)
