"""Backup queries over the given tables."""

from fleetlens.catalog.registry import FRAMES, query, rounded
from fleetlens.operators import backup as b

R = rounded
AS_OF = "2001-12-01 00:00:00"

FRAMES.update(
    bf_backups="""
        SELECT s.*, o_orderkey % 1000 AS media_set_id, CAST(ROUND(o_totalprice * 40) AS BIGINT) + 1 AS compressed_backup_size, o_orderdate - INTERVAL 1 HOUR AS backup_start_date
        FROM bf_backupset s JOIN orders ON o_orderkey = backup_set_id""",
    bf_media="""
        SELECT p_partkey AS media_set_id, CONCAT(CASE p_size % 3 WHEN 0 THEN 'c:' WHEN 1 THEN 'd:' ELSE 'z:' END, CHR(92), 'backup', CHR(92), p_name, CAST(p_partkey AS VARCHAR(10))) AS physical_device_name FROM part""",
    bf_restores="""
        SELECT o_orderkey + 7 AS restore_history_id, o_custkey AS database_id, o_orderkey AS backup_set_id, o_orderdate AS restore_date, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'P' THEN 'I' ELSE 'X' END AS restore_type,
            o_orderpriority AS user_name FROM orders""",
    bf_restore_files="""SELECT o_orderkey + 7 AS restore_history_id, CONCAT('/data/', CAST(o_orderkey AS VARCHAR(20))) AS destination_phys_name FROM orders""",
    bf_ship_primaries="""SELECT c_custkey AS primary_id, c_name AS primary_database FROM customer""",
    bf_ship_secondaries="""SELECT c_custkey AS primary_id, c_mktsegment AS secondary_server FROM customer WHERE c_acctbal > 0""",
    bf_ship_monitor="""SELECT c_custkey AS primary_id, c_nationkey * 10 AS backup_threshold FROM customer""",
    bf_ship_status="""
        SELECT c_name AS database_name, c_custkey % 2 = 0 AS is_primary, c_custkey % 31 = 0 AS status, c_custkey % 3 = 0 AS is_backup_alert_enabled, c_custkey % 5 = 0 AS is_restore_alert_enabled,
            c_custkey % 100 AS time_since_last_backup, 60 AS backup_threshold, c_custkey % 90 AS time_since_last_restore, 70 AS last_restored_latency, CASE WHEN c_custkey % 7 > 0 THEN c_mktsegment END AS last_backup_file,
            c_mktsegment AS last_restored_file FROM customer""",
    bf_ship_errors="""SELECT o_orderkey AS error_id, o_orderkey % 3 + 1 AS agent_type, o_orderpriority AS message FROM orders WHERE o_orderstatus = 'P'""",
    bf_encryption_keys="""SELECT c_custkey AS database_id, c_custkey % 60 AS encryptor_thumbprint FROM customer""",
    bf_certificates="""SELECT s_suppkey AS thumbprint, s_name AS name FROM supplier""",
)


@query("b1_last_backups", f"""
    SELECT d.*, MAX(backup_finish_date) FILTER (type = 'D') AS last_full, MAX(backup_finish_date) FILTER (type = 'I') AS last_differential, MAX(backup_finish_date) FILTER (type = 'L') AS last_log
    FROM bf_databases d LEFT JOIN bf_backupset b ON d.database_id = b.database_id AND backup_finish_date > TIMESTAMP '{AS_OF}' - INTERVAL 1200 DAY WHERE name <> 'tempdb' GROUP BY ALL""")
def _(t):
    return b.last_backups(t.databases, t.backupset, AS_OF, 1200)


@query("b2_stale_backups", f"""
    SELECT database_id, MAX(backup_finish_date) AS last_backup, DATE_DIFF('hour', MAX(backup_finish_date), TIMESTAMP '{AS_OF}') AS age_hours FROM bf_backupset WHERE type = 'L' GROUP BY 1
        HAVING MAX(backup_finish_date) < TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR
    UNION ALL SELECT database_id, NULL, 9999 FROM bf_databases WHERE name <> 'tempdb' AND database_id NOT IN (SELECT database_id FROM bf_backupset)""")
def _(t):
    return b.stale_backups(t.databases, t.backupset, AS_OF)


@query("b3_backup_history", f"""
    SELECT b.*, CASE type WHEN 'D' THEN 'Database' WHEN 'I' THEN 'Differential database' WHEN 'L' THEN 'Log' END AS backup_type, {R('backup_size', '1073741824', 2)} AS backup_gb, physical_device_name
    FROM bf_backups b JOIN bf_media m ON b.media_set_id = m.media_set_id WHERE backup_start_date >= TIMESTAMP '1999-01-01 00:00:00' AND type IN ('D', 'L')""")
def _(t):
    return b.backup_history(t.backups, t.media, "1999-01-01 00:00:00", ("D", "L"))


@query("b3_recent_full_backups", f"""
    SELECT backup_set_id, database_id, backup_finish_date, backup_size // 1048576 AS backup_mb, compressed_backup_size // 1048576 AS compressed_mb, {R('backup_size', 'compressed_backup_size', 2)} AS compression_ratio,
        DATE_DIFF('second', backup_start_date, backup_finish_date) AS elapsed_s, physical_device_name
    FROM bf_backups b JOIN bf_media m ON b.media_set_id = m.media_set_id WHERE type = 'D' ORDER BY backup_finish_date DESC, backup_set_id, physical_device_name LIMIT 30""")
def _(t):
    return b.recent_full_backups(t.backups, t.media)


@query("b4_lsn_chain", """
    WITH l AS (SELECT *, LAG(last_lsn) OVER (PARTITION BY database_id ORDER BY backup_finish_date, backup_set_id) AS prev_last_lsn FROM bf_backupset WHERE type = 'L')
    SELECT *, COALESCE(first_lsn <> prev_last_lsn, FALSE) AS is_gap FROM l""")
def _(t):
    return b.lsn_chain(t.backupset)


@query("b5_restore_history", """
    SELECT r.*, b.media_set_id, backup_start_date, backup_finish_date, physical_device_name, destination_phys_name,
        CASE restore_type WHEN 'D' THEN 'Database' WHEN 'F' THEN 'File' WHEN 'I' THEN 'Differential' WHEN 'L' THEN 'Log' ELSE restore_type END AS restore_type_text
    FROM bf_restores r JOIN bf_backups b ON r.backup_set_id = b.backup_set_id JOIN bf_media m ON b.media_set_id = m.media_set_id JOIN bf_restore_files f ON f.restore_history_id = r.restore_history_id""")
def _(t):
    return b.restore_history(t.restores, t.backups, t.media, t.restore_files)


@query("b6_rpo_status", f"""
    WITH l AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY database_id ORDER BY restore_date DESC, restore_history_id DESC) AS rn FROM bf_restores),
    d AS (SELECT l.database_id, physical_device_name, backup_start_date, restore_date, DATE_DIFF('minute', backup_start_date, TIMESTAMP '{AS_OF}') AS m
        FROM l JOIN bf_backups b ON l.backup_set_id = b.backup_set_id JOIN bf_media x ON b.media_set_id = x.media_set_id WHERE rn = 1)
    SELECT database_id, CASE WHEN m > 2000000 THEN 'RPO High Warning!' WHEN m > 1000000 THEN 'RPO Medium Warning!' WHEN m > 500000 THEN 'RPO Low Warning!' ELSE 'RPO Good' END AS status, physical_device_name AS last_file,
        backup_start_date AS created, restore_date AS restored, m AS minutes_behind FROM d""")
def _(t):
    return b.rpo_status(t.restores, t.backups, t.media, AS_OF, 500000, 1000000, 2000000)


@query("b7_backups_on_data_volume", f"""
    WITH m AS (SELECT UPPER(physical_device_name[1:2]) AS device, COUNT(DISTINCT physical_device_name) AS backup_files FROM bf_media WHERE media_set_id IN
        (SELECT media_set_id FROM bf_backups WHERE backup_start_date > TIMESTAMP '{AS_OF}' - INTERVAL 1000 DAY) GROUP BY 1),
    f AS (SELECT UPPER(physical_name[1:2]) AS device, COUNT(DISTINCT physical_name) AS database_files FROM bf_space_files WHERE database_id > 3 OR database_id = 2 GROUP BY 1)
    SELECT m.device, backup_files, database_files FROM m JOIN f ON m.device = f.device""")
def _(t):
    return b.backups_on_data_volume(t.media, t.backups, t.space_files, AS_OF, 1000)


@query("b8_log_shipping_config", """
    SELECT p.primary_id, primary_database, secondary_server, backup_threshold FROM bf_ship_primaries p JOIN bf_ship_secondaries s ON p.primary_id = s.primary_id JOIN bf_ship_monitor m ON p.primary_id = m.primary_id""")
def _(t):
    return b.log_shipping_config(t.ship_primaries, t.ship_secondaries, t.ship_monitor)


@query("b8_log_shipping_alerts", """
    SELECT database_name || CASE WHEN is_primary THEN ' (Primary)' ELSE ' (Secondary)' END AS object_name,
        CASE WHEN is_backup_alert_enabled AND time_since_last_backup > backup_threshold THEN 'log backup is late; last file: ' || COALESCE(last_backup_file, '(null)')
            WHEN is_restore_alert_enabled AND time_since_last_restore > last_restored_latency THEN 'log restore is late; last file: ' || last_restored_file ELSE 'reported as unhealthy' END AS details
    FROM bf_ship_status WHERE status OR (is_backup_alert_enabled AND time_since_last_backup > backup_threshold) OR (is_restore_alert_enabled AND time_since_last_restore > last_restored_latency)""")
def _(t):
    return b.log_shipping_alerts(t.ship_status)


@query("b8_log_shipping_errors", "SELECT *, CASE agent_type WHEN 1 THEN 'Backup' WHEN 2 THEN 'Copy' ELSE 'Restore' END AS agent FROM bf_ship_errors")
def _(t):
    return b.log_shipping_errors(t.ship_errors)


@query("b9_encryption_certificates", """
    SELECT k.database_id, d.name AS database_name, c.name AS certificate_name FROM bf_encryption_keys k JOIN bf_databases d ON k.database_id = d.database_id LEFT JOIN bf_certificates c ON c.thumbprint = k.encryptor_thumbprint""")
def _(t):
    return b.encryption_certificates(t.encryption_keys, t.certificates, t.databases)
