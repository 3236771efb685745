"""File input/output queries over the given tables."""

from fleetlens.catalog.registry import FRAMES, query, rounded
from fleetlens.operators import file_io

R = rounded
FRAMES.update(
    bf_named_databases="""SELECT s_suppkey AS database_id, s_name AS name FROM supplier""",
    bf_errorlog_files="""SELECT e.*, CAST(LENGTH(process_info) + LENGTH(log_text) AS BIGINT) % 8 AS log_number FROM bf_errorlog e""",
)
_JOIN = "FROM bf_file_stats s JOIN bf_files f ON s.database_id = f.database_id AND s.file_id = f.file_id"


@query("io1_file_latency", f"""
    SELECT s.database_id, s.file_id, physical_name, type, {R('size', '128', 2)} AS size_mb,
        {R('io_stall_read_ms', '(num_of_reads + 1)', 1)} AS avg_read_latency_ms,
        {R('io_stall_write_ms', '(num_of_writes + 1)', 1)} AS avg_write_latency_ms,
        {R('(io_stall_read_ms + io_stall_write_ms)', '(num_of_reads + num_of_writes + 1)', 1)} AS avg_io_latency_ms,
        CAST(io_stall_read_ms AS BIGINT) AS io_stall_read_ms, CAST(num_of_reads AS BIGINT) AS num_of_reads,
        CAST(io_stall_write_ms AS BIGINT) AS io_stall_write_ms, CAST(num_of_writes AS BIGINT) AS num_of_writes,
        CAST(io_stall_read_ms + io_stall_write_ms AS BIGINT) AS io_stalls, CAST(num_of_reads + num_of_writes AS BIGINT) AS total_io
    {_JOIN}""")
def _(t):
    return file_io.file_latency(t.file_stats, t.files)


@query("io2_drive_latency", f"""
    WITH d AS (SELECT UPPER(physical_name[1:2]) AS drive, SUM(num_of_reads) r, SUM(num_of_writes) w, SUM(io_stall_read_ms) sr,
        SUM(io_stall_write_ms) sw, SUM(num_of_bytes_read) br, SUM(num_of_bytes_written) bw {_JOIN} GROUP BY 1)
    SELECT drive, CAST(CASE WHEN r = 0 THEN 0 ELSE sr // r END AS BIGINT) AS read_latency,
        CAST(CASE WHEN w = 0 THEN 0 ELSE sw // w END AS BIGINT) AS write_latency,
        CAST(CASE WHEN r + w = 0 THEN 0 ELSE (sr + sw) // (r + w) END AS BIGINT) AS overall_latency,
        CAST(CASE WHEN r = 0 THEN 0 ELSE br // r END AS BIGINT) AS avg_bytes_read,
        CAST(CASE WHEN w = 0 THEN 0 ELSE bw // w END AS BIGINT) AS avg_bytes_write,
        CAST(CASE WHEN r + w = 0 THEN 0 ELSE (br + bw) // (r + w) END AS BIGINT) AS avg_bytes_transfer
    FROM d""")
def _(t):
    return file_io.drive_latency(t.file_stats, t.files)


@query("io3_drive_latency_smoothed", f"""
    SELECT physical_name[1:1] AS drive, {R('SUM(io_stall_read_ms)', '(1 + SUM(num_of_reads))', 1)} AS avg_read_disk_latency_ms,
        {R('SUM(io_stall_write_ms)', '(1 + SUM(num_of_writes))', 1)} AS avg_write_disk_latency_ms,
        {R('SUM(io_stall_read_ms + io_stall_write_ms)', '(1 + SUM(num_of_reads + num_of_writes))', 1)} AS avg_disk_latency_ms
    {_JOIN} GROUP BY 1""")
def _(t):
    return file_io.drive_latency_smoothed(t.file_stats, t.files)


@query("io4_io_share_by_database", f"""
    WITH d AS (SELECT database_id, SUM(num_of_bytes_read + num_of_bytes_written) // 1048576 AS t, SUM(num_of_bytes_read) // 1048576 AS r,
        SUM(num_of_bytes_written) // 1048576 AS w FROM bf_file_stats GROUP BY database_id)
    SELECT ROW_NUMBER() OVER (ORDER BY t DESC, database_id) AS io_rank, database_id, CAST(t AS BIGINT) AS total_mb, CAST(r AS BIGINT) AS read_mb,
        CAST(w AS BIGINT) AS write_mb, {R('t', 'SUM(t) OVER ()', 2, 100)} AS total_pct, {R('r', 'SUM(r) OVER ()', 2, 100)} AS read_pct,
        {R('w', 'SUM(w) OVER ()', 2, 100)} AS write_pct FROM d""")
def _(t):
    return file_io.io_share_by_database(t.file_stats)


@query("io5_io_mix_by_file", f"""
    SELECT s.database_id, s.file_id, physical_name, CAST(num_of_reads + num_of_writes AS BIGINT) AS reads_and_writes,
        {R('num_of_bytes_read', '1048576', 2)} AS mb_read, {R('num_of_bytes_written', '1048576', 2)} AS mb_written,
        {R('io_stall_read_ms', '(io_stall_read_ms + io_stall_write_ms)', 1, 100)} AS io_stall_reads_pct,
        {R('io_stall_write_ms', '(io_stall_read_ms + io_stall_write_ms)', 1, 100)} AS io_stall_writes_pct,
        {R('num_of_reads', '(num_of_reads + num_of_writes)', 1, 100)} AS count_reads_pct,
        {R('num_of_writes', '(num_of_reads + num_of_writes)', 1, 100)} AS count_writes_pct,
        {R('num_of_bytes_read', '(num_of_bytes_read + num_of_bytes_written)', 1, 100)} AS bytes_reads_pct,
        {R('num_of_bytes_written', '(num_of_bytes_read + num_of_bytes_written)', 1, 100)} AS bytes_writes_pct
    {_JOIN}""")
def _(t):
    return file_io.io_mix_by_file(t.file_stats, t.files)


@query("io6_io_threshold_check", f"""
    SELECT s.database_id, s.file_id, physical_name, type, UPPER(physical_name[1:2]) AS drive,
        CAST(io_stall_read_ms // num_of_reads AS BIGINT) AS avg_read_stall_ms, CASE type WHEN 0 THEN 30 WHEN 1 THEN 5 ELSE 0 END AS max_read_stall_ms,
        CAST(io_stall_write_ms // num_of_writes AS BIGINT) AS avg_write_stall_ms, CASE type WHEN 0 THEN 30 WHEN 1 THEN 2 ELSE 0 END AS max_write_stall_ms,
        {R('num_of_bytes_read', '1073741824', 1)} AS gb_read, {R('num_of_bytes_written', '1073741824', 1)} AS gb_written,
        CASE WHEN type = 1 THEN 'N/A' ELSE 'PAGEIOLATCH*' END AS read_wait,
        CASE type WHEN 1 THEN 'WRITELOG' WHEN 0 THEN 'ASYNC_IO_COMPLETION' ELSE 'xxx' END AS write_wait
    {_JOIN} WHERE num_of_reads > 0 AND num_of_writes > 0""")
def _(t):
    return file_io.io_threshold_check(t.file_stats, t.files)


@query("io7_io_counts_by_database", """
    SELECT s.database_id, name, CAST(SUM(num_of_reads) AS BIGINT) AS reads, CAST(SUM(num_of_writes) AS BIGINT) AS writes
    FROM bf_file_stats s JOIN bf_named_databases d ON s.database_id = d.database_id GROUP BY s.database_id, name""")
def _(t):
    return file_io.io_counts_by_database(t.file_stats, t.named_databases)


@query("io8_io_raw_latency", """
    WITH s AS (SELECT *, io_stall_read_ms // NULLIF(num_of_reads, 0) AS ar, io_stall_write_ms // NULLIF(num_of_writes, 0) AS aw FROM bf_file_stats)
    SELECT database_id, file_id, CAST(num_of_reads AS BIGINT) AS num_of_reads, CAST(num_of_writes AS BIGINT) AS num_of_writes,
        CAST(ar AS BIGINT) AS avg_read_latency_ms, CAST(aw AS BIGINT) AS avg_write_latency_ms,
        COALESCE(ar, 0) > 20 AS above_oltp, COALESCE(ar, 0) > 30 AS above_dw, COALESCE(aw, 0) > 5 AS above_log FROM s""")
def _(t):
    return file_io.io_raw_latency(t.file_stats)


@query("io9_io_window", f"""
    WITH p AS (SELECT *, LAG(counter_value) OVER (PARTITION BY instance_id, metric ORDER BY collected_at, event_id) AS prev FROM bf_snapshots),
    d AS (SELECT * EXCLUDE (prev), CASE WHEN counter_value >= prev THEN counter_value - prev END AS bytes_delta FROM p)
    SELECT *, {R('bytes_delta', '1048576', 4)} AS mb, {R('bytes_delta * 1024', '(1048576 * 100)', 4)} AS estimated_mb FROM d""")
def _(t):
    return file_io.io_window(t.snapshots, ["metric"], "counter_value", 100, 1024, ("collected_at", "event_id"))


@query("io10_io_warning_lines", """
    SELECT * FROM bf_errorlog_files WHERE log_text LIKE '%taking longer than 15 seconds%' AND log_number < 6""")
def _(t):
    return file_io.io_warning_lines(t.errorlog_files)


@query("io11_tempdb_file_stall", f"""
    SELECT s.database_id, s.file_id, physical_name, {R('io_stall_read_ms', 'num_of_reads', 4)} AS avg_read_stall_ms,
        {R('io_stall_write_ms', 'num_of_writes', 4)} AS avg_write_stall_ms {_JOIN} WHERE s.database_id = 2 AND type = 0""")
def _(t):
    return file_io.tempdb_file_stall(t.file_stats, t.files)
