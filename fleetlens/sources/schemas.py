"""Declared schemas of the landed views. Every view also carries `instance_id STRING,
collected_at TIMESTAMP_NTZ` and, as partition column, `collected_date DATE`."""

COMMON = "instance_id STRING, collected_at TIMESTAMP_NTZ, collected_date DATE"

VIEWS = {
    "waits": "wait_type STRING, wait_time_ms BIGINT, signal_wait_time_ms BIGINT, waiting_tasks_count BIGINT",
    "waiting_tasks": "session_id BIGINT, task_id BIGINT, wait_type STRING, wait_duration_ms BIGINT, blocking_session_id BIGINT, resource_address STRING, resource_description STRING",
    "file_stats": "database_id INT, file_id INT, num_of_reads BIGINT, num_of_writes BIGINT, io_stall_read_ms BIGINT, io_stall_write_ms BIGINT, io_stall BIGINT, num_of_bytes_read BIGINT, num_of_bytes_written BIGINT, size_on_disk_bytes BIGINT",
    "files": "database_id INT, file_id INT, name STRING, physical_name STRING, type INT, size BIGINT, growth INT, is_percent_growth BOOLEAN, max_size BIGINT, data_space_id INT",
    "query_stats": """plan_handle STRING, sql_handle STRING, database_id INT, execution_count BIGINT, total_worker_time BIGINT, min_worker_time BIGINT, max_worker_time BIGINT,
        total_elapsed_time BIGINT, min_elapsed_time BIGINT, max_elapsed_time BIGINT, total_logical_reads BIGINT, min_logical_reads BIGINT, max_logical_reads BIGINT, total_physical_reads BIGINT,
        total_logical_writes BIGINT, statement_start_offset INT, statement_end_offset INT, creation_time TIMESTAMP_NTZ, last_execution_time TIMESTAMP_NTZ""",
    "texts": "plan_handle STRING, sql_handle STRING, text STRING",
    "cached_plans": "plan_handle STRING, usecounts BIGINT, objtype STRING, cacheobjtype STRING, size_in_bytes BIGINT, text STRING",
    "plans": "plan_handle STRING, query_plan STRING",
    "missing_indexes": "group_handle BIGINT, statement STRING, equality_columns STRING, inequality_columns STRING, included_columns STRING, user_seeks BIGINT, user_scans BIGINT, avg_total_user_cost DOUBLE, avg_user_impact DOUBLE, last_user_seek TIMESTAMP_NTZ",
    "store_runtime": "query_id BIGINT, plan_id BIGINT, count_executions BIGINT, avg_duration BIGINT, avg_logical_io_reads BIGINT, start_time TIMESTAMP_NTZ, execution_type_desc STRING",
    "sessions": """session_id BIGINT, blocking_session_id BIGINT, status STRING, login_name STRING, host_name STRING, program_name STRING, database_id INT, open_tran_count INT,
        transaction_isolation_level INT, is_user_process BOOLEAN, login_time TIMESTAMP_NTZ""",
    "requests": """session_id BIGINT, request_id BIGINT, command STRING, wait_type STRING, cpu_time BIGINT, reads BIGINT, writes BIGINT, logical_reads BIGINT, total_elapsed_time BIGINT, start_time TIMESTAMP_NTZ,
        percent_complete DOUBLE, estimated_completion_time BIGINT, sql_handle STRING, statement_start_offset INT, statement_end_offset INT""",
    "locks": "resource_type STRING, resource_database_id INT, resource_associated_entity_id BIGINT, request_mode STRING, request_status STRING, request_session_id BIGINT, lock_owner_address STRING",
    "counters": "object_name STRING, counter_name STRING, instance_name STRING, cntr_value BIGINT",
    "ring_buffer": "ring_buffer_type STRING, timestamp BIGINT, record STRING",
    "buffers": "database_id INT, file_id INT, page_id BIGINT, allocation_unit_id BIGINT, free_space_in_bytes INT, read_microsec BIGINT",
    "indexes": "object_id BIGINT, index_id INT, name STRING, type INT, is_unique BOOLEAN, is_primary_key BOOLEAN, is_unique_constraint BOOLEAN, is_disabled BOOLEAN, filter_definition STRING",
    "index_columns": "object_id BIGINT, index_id INT, column_id INT, key_ordinal INT, is_descending_key BOOLEAN, is_included_column BOOLEAN",
    "index_usage": "object_id BIGINT, index_id INT, user_seeks BIGINT, user_scans BIGINT, user_lookups BIGINT, user_updates BIGINT, last_user_seek TIMESTAMP_NTZ, last_user_scan TIMESTAMP_NTZ, last_user_lookup TIMESTAMP_NTZ",
    "index_op_stats": "object_id BIGINT, index_id INT, partition_number INT, row_lock_wait_count BIGINT, row_lock_wait_in_ms BIGINT, page_lock_wait_count BIGINT, page_lock_wait_in_ms BIGINT",
    "partition_stats": "object_id BIGINT, index_id INT, partition_number INT, row_count BIGINT, used_page_count BIGINT, reserved_page_count BIGINT, in_row_data_page_count BIGINT, data_compression_desc STRING",
    "stats_properties": "object_id BIGINT, stats_id INT, name STRING, last_updated TIMESTAMP_NTZ, row_count BIGINT, rows_sampled BIGINT, modification_counter BIGINT",
    "foreign_keys": "parent_object_id BIGINT, constraint_object_id BIGINT, name STRING, is_disabled BOOLEAN, is_not_trusted BOOLEAN, is_not_for_replication BOOLEAN",
    "fk_columns": "constraint_object_id BIGINT, constraint_column_id INT, parent_column_id INT, column_name STRING",
    "backupset": """database_id INT, database_name STRING, type STRING, backup_set_id BIGINT, media_set_id BIGINT, backup_start_date TIMESTAMP_NTZ, backup_finish_date TIMESTAMP_NTZ, backup_size BIGINT,
        compressed_backup_size BIGINT, first_lsn DECIMAL(25,0), last_lsn DECIMAL(25,0), user_name STRING""",
    "jobs": "job_id STRING, name STRING, enabled BOOLEAN, owner_sid STRING, owner_name STRING, category_id INT, date_created TIMESTAMP_NTZ",
    "job_history": "job_id STRING, history_id BIGINT, step_id INT, run_status INT, run_date INT, run_time INT, run_duration INT, message STRING",
    "replica_states": """database_id INT, replica_id STRING, role_desc STRING, connected_state_desc STRING, synchronization_state_desc STRING, synchronization_health_desc STRING, database_state_desc STRING, is_suspended BOOLEAN,
        log_send_queue_size BIGINT, log_send_rate BIGINT, redo_queue_size BIGINT, redo_rate BIGINT, last_commit_time TIMESTAMP_NTZ""",
    "config": "name STRING, value BIGINT, value_in_use BIGINT",
    "databases": "database_id INT, name STRING, state_desc STRING, recovery_model_desc STRING, page_verify_option_desc STRING, log_reuse_wait_desc STRING, is_auto_close_on BOOLEAN, is_auto_shrink_on BOOLEAN, is_auto_create_stats_on BOOLEAN, is_auto_update_stats_on BOOLEAN, compatibility_level INT, owner_sid STRING",
    "volumes": "volume_mount_point STRING, logical_volume_name STRING, total_bytes BIGINT, available_bytes BIGINT",
    "errorlog": "log_date TIMESTAMP_NTZ, process_info STRING, log_text STRING, log_number INT",
}


def declared(view: str) -> str:
    """The full schema of a landed view."""
    return f"{COMMON}, {VIEWS[view]}"
