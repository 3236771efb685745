"""Sessions, blocking, locks, transactions and deadlock counts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_time, coded, fleet_keys, int_div, pad, ratio
from fleetlens.plans.forest import descendant_counts, paths_from_roots
from fleetlens.plans.joins import join_null_safe
from fleetlens.plans.ordering import order_columns, top_n
from fleetlens.plans.sequences import counter_delta

_FILTER_COLUMNS = {"session": "session_id", "program": "program_name", "login": "login_name", "host": "host_name", "database": "database_name"}


def _matches(filter_type: str, value: str | int) -> Column:
    column = _FILTER_COLUMNS[filter_type]
    if filter_type == "session":
        return F.lit(True) if int(value) == 0 else F.col(column) == int(value)
    return F.col(column).like(str(value))


def active_sessions(sessions: DataFrame, requests: DataFrame | None = None, include: tuple[str, str | int] | None = None,
                    exclude: tuple[str, str | int] | None = None, show_sleeping: int = 1, show_system: bool = False,
                    own_session: int | None = None) -> DataFrame:
    """Sessions worth looking at.

    `include` and `exclude` are (kind, pattern) pairs over session, program,
    login, host or database, with `%` and `_`. Sleeping sessions: 0 none, 1
    only those with an open transaction, 2 all.
    """
    if show_sleeping not in (0, 1, 2):
        raise ValueError("show_sleeping must be 0, 1 or 2")
    out = sessions
    if include is not None:
        out = out.where(_matches(*include))
    if exclude is not None:
        # an exclusion of session 0 excludes nothing
        out = out if exclude[0] == "session" and int(exclude[1]) == 0 else out.where(~F.coalesce(_matches(*exclude), F.lit(False)))
    if show_sleeping < 2:
        awake = F.col("status") != "sleeping"
        out = out.where(awake if show_sleeping == 0 else awake | (F.col("open_tran_count") > 0))
    if not show_system and "is_user_process" in sessions.columns:
        out = out.where("is_user_process")
    if own_session is not None:
        out = out.where(F.col("session_id") != own_session)
    if requests is not None:
        keys = [*fleet_keys(sessions, requests), "session_id"]
        out = out.join(requests, keys, "left")
    return out


def session_delta(snapshots: DataFrame, metrics: Sequence[str], order: Sequence[str] = ("collected_at",), bucket: Column | None = None) -> DataFrame:
    """Growth of the metrics of a running request since the sample before; NULL
    for its first sample and where a value fell."""
    bucket = F.to_date("collected_at") if bucket is None else bucket
    keys = [*fleet_keys(snapshots), "session_id", "request_id", "start_time"]
    return counter_delta(snapshots, keys, order, metrics, bucket).drop(*[f"prev_{m}" for m in metrics])


def blocking_tree(sessions: DataFrame) -> DataFrame:
    """The blocking trees as indented text; sort by `path` to print them."""
    keys = fleet_keys(sessions)
    paths = paths_from_roots(sessions, keys, "session_id", "blocking_session_id")
    # a root that blocks nobody is no tree
    heads = paths.where(F.size("path") > 1).select(*keys, F.col("path")[0].alias("_root")).distinct()
    paths = join_null_safe(paths.withColumn("_root", F.col("path")[0]), heads, [*keys, "_root"], "left_semi")
    level = F.size("path") - 1
    text = F.concat(F.lit("    "), F.repeat(F.lit("|         "), level), F.when(level == 0, "HEAD -  ").otherwise("|------  "), F.col("node").cast("string"))
    if "text" in sessions.columns:
        paths = join_null_safe(paths, sessions.groupBy(*keys, F.col("session_id").alias("node")).agg(F.min("text").alias("text")), [*keys, "node"])
        text = F.concat(text, F.lit(" "), F.coalesce("text", F.lit("")))
    return paths.select(*keys, F.col("node").alias("session_id"), level.alias("level"),
                        F.array_join(F.transform("path", lambda x: pad(x, 10)), "").alias("path"), text.alias("blocking_tree"))


def blocked_session_count(sessions: DataFrame) -> DataFrame:
    """How many sessions each session blocks, directly or through others."""
    keys = fleet_keys(sessions)
    return descendant_counts(sessions, keys, "session_id", "blocking_session_id").select(
        *keys, F.col("node").alias("session_id"), F.col("descendants").alias("blocked_session_count"))


def blocking_pairs(locks: DataFrame, waiting_tasks: DataFrame, batches: DataFrame) -> DataFrame:
    """Who waits for which lock of whom, with both batches. `batches`: session_id, text."""
    keys = fleet_keys(locks, waiting_tasks, batches)
    waits = waiting_tasks.select(*keys, F.col("resource_address").alias("lock_owner_address"), "wait_duration_ms", F.col("blocking_session_id").alias("blocker_session_id"))
    pairs = locks.join(waits, [*keys, "lock_owner_address"])
    waiter = batches.select(*keys, F.col("session_id").alias("request_session_id"), F.col("text").alias("waiter_batch"))
    blocker = batches.select(*keys, F.col("session_id").alias("blocker_session_id"), F.col("text").alias("blocker_batch"))
    return (pairs.join(waiter, [*keys, "request_session_id"], "left").join(blocker, [*keys, "blocker_session_id"], "left").select(
        *keys, F.col("resource_type").alias("lock_type"), F.col("resource_database_id").alias("database_id"), F.col("resource_associated_entity_id").alias("blocked_object"),
        F.col("request_mode").alias("lock_requested"), F.col("request_session_id").alias("waiter_session_id"), F.col("wait_duration_ms").alias("wait_ms"),
        "waiter_batch", "blocker_session_id", "blocker_batch"))


def locks_by_object(locks: DataFrame, partitions: DataFrame, indexes: DataFrame, objects: DataFrame) -> DataFrame:
    """Locks with the object and index they concern: table locks by object id,
    key, page and row locks through the partition."""
    keys = fleet_keys(locks, partitions, indexes, objects)
    entity = "resource_associated_entity_id"
    via = F.col("resource_type").isin("KEY", "PAGE", "RID")
    whole = F.col("resource_type").isin("DATABASE", "FILE", "METADATA")
    parts = partitions.select(*keys, F.col("hobt_id").alias("_hobt"), F.col("object_id").alias("_part_object"), "index_id")
    out = locks.withColumn("_hobt", F.when(via, F.col(entity))).join(parts, [*keys, "_hobt"], "left")
    out = out.withColumn("object_id", F.when(F.col("resource_type") == "OBJECT", F.col(entity)).otherwise(F.col("_part_object")))
    out = out.join(objects.select(*keys, "object_id", F.col("name").alias("_name")), [*keys, "object_id"], "left")
    out = out.join(indexes.select(*keys, "object_id", "index_id", F.col("name").alias("index_name")), [*keys, "object_id", "index_id"], "left")
    name = F.when(whole, F.col("resource_type")).when(via | (F.col("resource_type") == "OBJECT"), F.col("_name")).otherwise("Unidentified")
    return out.withColumn("requested_object_name", name).drop("_hobt", "_part_object", "_name")


def locks_document(locks: DataFrame) -> DataFrame:
    """Locks of a session, database and object as one nested document.

    Requests are counted before they are nested, so a document has one entry for each
    kind, mode and status of lock that the object has, however many requests there are.
    """
    keys = [*fleet_keys(locks), "request_session_id", "resource_database_id", "resource_associated_entity_id"]
    per = locks.groupBy(*keys, "resource_type", "request_mode", "request_status").agg(F.count(F.lit(1)).alias("request_count"))
    lock = F.struct("resource_type", "request_mode", "request_status", "request_count")
    return per.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(lock))).alias("locks"))


def select_output_columns(df: DataFrame, patterns: str, sort: str | None = None, descending: bool = False) -> DataFrame:
    """Columns chosen by a list such as `[session_id][%delta][%]`: the order of
    the list counts, each column is taken once. `sort` is one column, or a
    bracket list of columns each followed by an optional ASC or DESC; ties go
    by the ids of the rows, so that one frequent value is not one task's work."""
    chosen: list[str] = []
    for token in re.findall(r"\[([^\]]*)\]", patterns):
        shape = re.compile("".join(".*" if x == "%" else "." if x == "_" and "%" not in token and token not in df.columns else re.escape(x) for x in token), re.IGNORECASE)
        chosen += [col for col in df.columns if shape.fullmatch(col) and col not in chosen]
    if not chosen:
        raise ValueError(f"no column matches {patterns!r}")
    out = df.select(*chosen)
    if sort:
        terms = re.findall(r"\[([^\]]+)\]\s*(ASC|DESC)?", sort, re.IGNORECASE) or [(sort, "DESC" if descending else "ASC")]
        unknown = [t for t, _ in terms if t not in chosen]
        if unknown:
            raise ValueError(f"cannot sort by {unknown}")
        sorted_by = [t for t, _ in terms]
        ids = [x for x in df.columns if x.endswith("_id") and x not in sorted_by]
        wide = df.select(*chosen, *[x for x in ids if x not in chosen])
        out = wide.orderBy(*order_columns([("-" if d.upper() == "DESC" else "") + t for t, d in terms] + ids)).select(*chosen)
    return out


def transaction_log_writes(transactions: DataFrame, databases: DataFrame) -> DataFrame:
    """Per session the log writes of its transactions as `db: writes (n kB)`,
    the time of the first one and whether one began implicitly."""
    keys = fleet_keys(transactions, databases)
    per = transactions.groupBy(*keys, "session_id", "database_id").agg(
        F.count(F.lit(1)).alias("_writes"), F.sum("log_bytes_used").alias("_bytes"), F.min("begin_time").alias("_start"),
        F.max(F.col("is_implicit").cast("int") if "is_implicit" in transactions.columns else F.lit(0)).alias("_implicit"))
    named = per.join(databases.select(*keys, "database_id", "name"), [*keys, "database_id"], "left")
    text = F.concat(F.coalesce("name", F.lit("(null)")), F.lit(": "), F.col("_writes").cast("string"), F.lit(" ("), int_div("_bytes", F.lit(1024)).cast("string"), F.lit(" kB)"))
    entries = F.array_sort(F.collect_list(F.struct("database_id", text.alias("t"))))
    return named.groupBy(*keys, "session_id").agg(
        F.min("_start").alias("tran_start_time"), F.array_join(F.transform(entries, lambda x: x.t), ", ").alias("tran_log_writes"),
        F.when(F.max("_implicit") == 1, "ON").otherwise("OFF").alias("implicit_tran"))


def average_elapsed(sessions: DataFrame, query_stats: DataFrame) -> DataFrame:
    """Average elapsed time of earlier executions of the statement a session runs."""
    keys = fleet_keys(sessions, query_stats)
    on = [*keys, *[k for k in ("plan_handle", "sql_handle", "statement_start_offset") if k in sessions.columns and k in query_stats.columns]]
    stats = query_stats.groupBy(*on).agg(F.sum("total_elapsed_time").alias("_e"), F.sum("execution_count").alias("_n"))
    return sessions.join(stats, on, "left").withColumn("avg_elapsed_time", int_div("_e", "_n")).drop("_e", "_n")


def tempdb_by_session(space_usage: DataFrame, sessions: DataFrame, databases: DataFrame, outstanding: bool = False) -> DataFrame:
    """Temporary space per session: allocated megabytes, or pages not yet given back."""
    keys = fleet_keys(space_usage, sessions, databases)
    kinds = ("internal_objects", "user_objects")
    used = space_usage.where(F.col("internal_objects_alloc_page_count") + F.col("user_objects_alloc_page_count") > 0)
    per = used.groupBy(*keys, "session_id").agg(
        *[F.sum(f"{k}_alloc_page_count").alias(f"_{k}") for k in kinds],
        *([F.sum(F.col(f"{k}_alloc_page_count") - F.col(f"{k}_dealloc_page_count")).alias(f"outstanding_{k}_pages") for k in kinds] if outstanding else []))
    out = (per.join(sessions.select(*keys, "session_id", "login_name", "database_id"), [*keys, "session_id"], "left")
           .join(databases.select(*keys, "database_id", F.col("name").alias("database_name")), [*keys, "database_id"], "left"))
    shown = [f"outstanding_{k}_pages" for k in kinds] if outstanding else [ratio(F.col(f"_{k}") * 8, F.lit(1024), 2).alias(f"{k}_mb") for k in kinds]
    return out.select(*keys, "session_id", "login_name", "database_id", "database_name", *shown)


#: Fixed texts of transaction codes.
TRANSACTION_TYPES = {1: "Read/write transaction", 2: "Read-only transaction", 3: "System transaction", 4: "Distributed transaction"}
TRANSACTION_STATES = {
    0: "The transaction has not been completely initialized yet",
    1: "The transaction has been initialized but has not started",
    2: "The transaction is active",
    3: "The transaction has ended. This is used for read-only transactions",
    4: ("The commit process has been initiated on the distributed transaction. This is for distributed transactions only. "
        "The distributed transaction is still active but further processing cannot take place"),
    5: "The transaction is in a prepared state and waiting resolution.",
    6: "The transaction has been committed",
    7: "The transaction is being rolled back",
    8: "The transaction has been rolled back",
}
ISOLATION_LEVELS = {0: "Unspecified", 1: "READ UNCOMMITTED", 2: "READ COMMITTED", 3: "REPEATABLE READ", 4: "SERIALIZABLE", 5: "SNAPSHOT"}


def open_transactions(db_tran: DataFrame, session_tran: DataFrame, databases: DataFrame) -> DataFrame:
    """Open transactions with their log use, type and state in words."""
    keys = fleet_keys(db_tran, session_tran, databases)
    name = F.when(F.col("name").isNull() & (F.col("database_id") == 2), "TEMPDB").otherwise(F.col("name"))
    return (db_tran.join(session_tran.select(*keys, "transaction_id", "session_id"), [*keys, "transaction_id"])
            .join(databases.select(*keys, "database_id", "name"), [*keys, "database_id"], "left")
            .select(*keys, "session_id", "transaction_id", "database_id", name.alias("database_name"), ratio("log_bytes_used", F.lit(1024), 2).alias("log_used_kb"), "begin_time",
                    coded("database_transaction_type", TRANSACTION_TYPES).alias("transaction_type"), coded("database_transaction_state", TRANSACTION_STATES).alias("transaction_state")))


def longest_snapshot_transactions(transactions: DataFrame, sessions: DataFrame, n: int = 5) -> DataFrame:
    """The longest-running snapshot transactions with their program and open count."""
    keys = fleet_keys(transactions, sessions)
    known = transactions.join(sessions.select(*keys, "session_id"), [*keys, "session_id"], "left_semi")
    best = top_n(known, keys, ["-elapsed_time_seconds", "transaction_id"], n)
    return best.join(sessions.select(*keys, "session_id", "program_name", "open_tran_count", "status"), [*keys, "session_id"])


def deadlocks_per_day(counters: DataFrame, databases: DataFrame, as_of: Column | str) -> DataFrame:
    """Deadlocks counted since start, per day; NULL on the day of the start."""
    keys = fleet_keys(counters, databases)
    total = counters.where((F.rtrim("counter_name") == "Number of Deadlocks/sec") & (F.rtrim("instance_name") == "_Total"))
    start = databases.where(F.col("name") == "tempdb").select(*keys, "create_date")
    days = F.datediff(F.to_date(as_time(as_of)), F.to_date("create_date"))
    joined = total.join(start, keys) if keys else total.withColumn("create_date", start.agg(F.max("create_date").alias("d")).scalar())
    return joined.select(*keys, int_div("cntr_value", F.nullif(days, F.lit(0))).alias("average_per_day"),
                         F.concat(F.col("cntr_value").cast("string"), F.lit(" deadlocks since the start")).alias("details"),
                         F.col("create_date").alias("startup_time"))


def isolation_level_text(sessions: DataFrame) -> DataFrame:
    """Add the isolation level in words."""
    return sessions.withColumn("isolation_level", coded("transaction_isolation_level", ISOLATION_LEVELS))


def temp_object_owner(trace_events: DataFrame, objects: DataFrame) -> DataFrame:
    """Who created each temporary object, from committed object-created events of the temporary database."""
    keys = [*fleet_keys(trace_events, objects), "object_id"]
    created = trace_events.where((F.col("database_id") == 2) & (F.col("event_class") == 46) & (F.col("event_subclass") == 1))
    return created.join(objects.where(F.col("name").startswith("#")).select(*keys, "name", "create_date"), keys)


def resolve_wait_resource(partitions: DataFrame, objects: DataFrame, indexes: DataFrame, hobt_id: int | None = None) -> DataFrame:
    """The table and index behind partition ids."""
    keys = fleet_keys(partitions, objects, indexes)
    wanted = partitions if hobt_id is None else partitions.where(F.col("hobt_id") == hobt_id)
    return (wanted.select(*keys, "hobt_id", "object_id", "index_id")
            .join(objects.select(*keys, "object_id", F.col("name").alias("table_name")), [*keys, "object_id"])
            .join(indexes.select(*keys, "object_id", "index_id", F.col("name").alias("index_name")), [*keys, "object_id", "index_id"]))


#: Column lists and sort orders of the usual questions.
RECIPES = {
    "delta": ("[dd%][session_id][%delta][login_name][sql_text][%]", None),
    "transactions": ("[dd%][session_id][tran%][login_name][sql_text][%]", None),
    "memory": ("[dd%][session_id][%memory%][login_name][sql_text][%]", None),
    "tempdb": ("[start_time][session_id][temp%][sql_text][query_plan][wait_info][%]", "[tempdb_current] DESC"),
    "block_leaders": ("[start_time][session_id][block%][login%][locks][sql_text][%]", "[blocked_session_count] DESC"),
    "extended": ("[dd%][session_id][sql_text][sql_command][login_name][wait_info][tasks][%]", "[cpu] DESC"),
}


def activity_recipe(name: str, sessions: DataFrame, *details: DataFrame) -> DataFrame:
    """A preset view: active sessions, joined with per-session details (such as
    `blocked_session_count` or `tempdb_by_session`), in the preset's column order."""
    out = active_sessions(sessions)
    for d in details:
        keys = [*fleet_keys(out, d), "session_id"]
        fresh = [x for x in d.columns if x in keys or x not in out.columns]
        out = out.join(d.select(*fresh), keys, "left")
    columns, sort = RECIPES[name]
    return select_output_columns(out, columns, sort if sort and re.findall(r"\[([^\]]+)\]", sort)[0] in out.columns else None)
