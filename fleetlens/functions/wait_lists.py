"""Wait types that say nothing about load, per edition (fixed values)."""

SERVER = (
    "BROKER_EVENTHANDLER BROKER_RECEIVE_WAITFOR BROKER_TASK_STOP BROKER_TO_FLUSH BROKER_TRANSMITTER CHECKPOINT_QUEUE "
    "CHKPT CLR_AUTO_EVENT CLR_MANUAL_EVENT CLR_SEMAPHORE CXCONSUMER DBMIRROR_DBM_EVENT DBMIRROR_EVENTS_QUEUE "
    "DBMIRROR_WORKER_QUEUE DBMIRRORING_CMD DIRTY_PAGE_POLL DISPATCHER_QUEUE_SEMAPHORE EXECSYNC FSAGENT "
    "FT_IFTS_SCHEDULER_IDLE_WAIT FT_IFTSHC_MUTEX HADR_CLUSAPI_CALL HADR_FILESTREAM_IOMGR_IOCOMPLETION "
    "HADR_LOGCAPTURE_WAIT HADR_NOTIFICATION_DEQUEUE HADR_TIMER_TASK HADR_WORK_QUEUE KSOURCE_WAKEUP LAZYWRITER_SLEEP "
    "LOGMGR_QUEUE MEMORY_ALLOCATION_EXT ONDEMAND_TASK_QUEUE PARALLEL_REDO_DRAIN_WORKER PARALLEL_REDO_LOG_CACHE "
    "PARALLEL_REDO_TRAN_LIST PARALLEL_REDO_WORKER_SYNC PARALLEL_REDO_WORKER_WAIT_WORK "
    "PREEMPTIVE_HADR_LEASE_MECHANISM PREEMPTIVE_SP_SERVER_DIAGNOSTICS PREEMPTIVE_OS_LIBRARYOPS PREEMPTIVE_OS_COMOPS "
    "PREEMPTIVE_OS_CRYPTOPS PREEMPTIVE_OS_PIPEOPS PREEMPTIVE_OS_AUTHENTICATIONOPS PREEMPTIVE_OS_GENERICOPS "
    "PREEMPTIVE_OS_VERIFYTRUST PREEMPTIVE_OS_FILEOPS PREEMPTIVE_OS_DEVICEOPS PREEMPTIVE_OS_QUERYREGISTRY "
    "PREEMPTIVE_OS_WRITEFILE PREEMPTIVE_OS_WRITEFILEGATHER PREEMPTIVE_XE_CALLBACKEXECUTE PREEMPTIVE_XE_DISPATCHER "
    "PREEMPTIVE_XE_GETTARGETSTATE PREEMPTIVE_XE_SESSIONCOMMIT PREEMPTIVE_XE_TARGETINIT PREEMPTIVE_XE_TARGETFINALIZE "
    "PWAIT_ALL_COMPONENTS_INITIALIZED PWAIT_DIRECTLOGCONSUMER_GETNEXT PWAIT_EXTENSIBILITY_CLEANUP_TASK "
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP QDS_ASYNC_QUEUE QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP "
    "REQUEST_FOR_DEADLOCK_SEARCH RESOURCE_QUEUE SERVER_IDLE_CHECK SLEEP_BPOOL_FLUSH SLEEP_DBSTARTUP SLEEP_DCOMSTARTUP "
    "SLEEP_MASTERDBREADY SLEEP_MASTERMDREADY SLEEP_MASTERUPGRADED SLEEP_MSDBSTARTUP SLEEP_SYSTEMTASK SLEEP_TASK "
    "SLEEP_TEMPDBSTARTUP SNI_HTTP_ACCEPT SOS_WORK_DISPATCHER SP_SERVER_DIAGNOSTICS_SLEEP SOS_WORKER_MIGRATION "
    "VDI_CLIENT_OTHER SQLTRACE_BUFFER_FLUSH SQLTRACE_INCREMENTAL_FLUSH_SLEEP SQLTRACE_WAIT_ENTRIES "
    "STARTUP_DEPENDENCY_MANAGER WAIT_FOR_RESULTS WAITFOR WAITFOR_TASKSHUTDOWN WAIT_XTP_HOST_WAIT "
    "WAIT_XTP_OFFLINE_CKPT_NEW_LOG WAIT_XTP_CKPT_CLOSE WAIT_XTP_RECOVERY XE_BUFFERMGR_ALLPROCESSED_EVENT "
    "XE_DISPATCHER_JOIN XE_DISPATCHER_WAIT XE_LIVE_TARGET_TVF XE_TIMER_EVENT"
).split()

# What the other editions leave out of, or add to, the server list.
_MANAGED_WITHOUT = {"PREEMPTIVE_OS_WRITEFILEGATHER", "SOS_WORKER_MIGRATION", "VDI_CLIENT_OTHER"}
_MANAGED_WITH = ["HADR_FABRIC_CALLBACK"]
_CLOUD_WITHOUT = {
    "CXCONSUMER", "PARALLEL_REDO_DRAIN_WORKER", "PARALLEL_REDO_LOG_CACHE", "PARALLEL_REDO_TRAN_LIST",
    "PARALLEL_REDO_WORKER_SYNC", "PARALLEL_REDO_WORKER_WAIT_WORK", "PREEMPTIVE_OS_WRITEFILEGATHER",
    "PWAIT_EXTENSIBILITY_CLEANUP_TASK", "SOS_WORK_DISPATCHER", "SOS_WORKER_MIGRATION", "VDI_CLIENT_OTHER",
    "STARTUP_DEPENDENCY_MANAGER",
}
_CLOUD_WITH = ["PREEMPTIVE_ODBCOPS", "PREEMPTIVE_XHTTP", "RESOURCE_GOVERNOR_IDLE"]
_CLASSIC_WITHOUT = {
    "PREEMPTIVE_HADR_LEASE_MECHANISM", "PREEMPTIVE_SP_SERVER_DIAGNOSTICS", "PREEMPTIVE_OS_LIBRARYOPS",
    "PREEMPTIVE_OS_COMOPS", "PREEMPTIVE_OS_CRYPTOPS", "PREEMPTIVE_OS_PIPEOPS", "PREEMPTIVE_OS_AUTHENTICATIONOPS",
    "PREEMPTIVE_OS_GENERICOPS", "PREEMPTIVE_OS_VERIFYTRUST", "PREEMPTIVE_OS_FILEOPS", "PREEMPTIVE_OS_DEVICEOPS",
    "PREEMPTIVE_OS_QUERYREGISTRY", "PREEMPTIVE_OS_WRITEFILE", "PREEMPTIVE_OS_WRITEFILEGATHER",
    "PREEMPTIVE_XE_CALLBACKEXECUTE", "PREEMPTIVE_XE_DISPATCHER", "PREEMPTIVE_XE_SESSIONCOMMIT",
    "PREEMPTIVE_XE_TARGETINIT", "PREEMPTIVE_XE_TARGETFINALIZE", "PWAIT_EXTENSIBILITY_CLEANUP_TASK",
    "SOS_WORKER_MIGRATION", "STARTUP_DEPENDENCY_MANAGER", "XE_BUFFERMGR_ALLPROCESSED_EVENT", "XE_LIVE_TARGET_TVF",
}
_CLASSIC_WITH = ["PREEMPTIVE_OS_FLUSHFILEBUFFERS", "QDS_SHUTDOWN_QUEUE", "REDO_THREAD_PENDING_WORK"]

#: The short list of the daily report.
DAILY = (
    "SLEEP_TASK BROKER_TASK_STOP BROKER_TO_FLUSH SQLTRACE_BUFFER_FLUSH CLR_AUTO_EVENT CLR_MANUAL_EVENT "
    "LAZYWRITER_SLEEP SLEEP_SYSTEMTASK SLEEP_BPOOL_FLUSH BROKER_EVENTHANDLER XE_DISPATCHER_WAIT FT_IFTSHC_MUTEX "
    "CHECKPOINT_QUEUE FT_IFTS_SCHEDULER_IDLE_WAIT BROKER_TRANSMITTER KSOURCE_WAKEUP LOGMGR_QUEUE "
    "ONDEMAND_TASK_QUEUE REQUEST_FOR_DEADLOCK_SEARCH XE_TIMER_EVENT BAD_PAGE_PROCESS DBMIRROR_EVENTS_QUEUE "
    "BROKER_RECEIVE_WAITFOR PREEMPTIVE_OS_GETPROCADDRESS PREEMPTIVE_OS_AUTHENTICATIONOPS WAITFOR "
    "DISPATCHER_QUEUE_SEMAPHORE XE_DISPATCHER_JOIN RESOURCE_QUEUE"
).split()

EDITIONS = {
    "server": SERVER,
    "managed": [w for w in SERVER if w not in _MANAGED_WITHOUT] + _MANAGED_WITH,
    "cloud": [w for w in SERVER if w not in _CLOUD_WITHOUT] + _CLOUD_WITH,
    "classic": [w for w in SERVER if w not in _CLASSIC_WITHOUT] + _CLASSIC_WITH,
    "daily": DAILY,
}
