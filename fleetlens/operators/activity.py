"""The composed activity row: a session's request with all that is known about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_time, clock_text, fleet_keys, int_div, micros
from fleetlens.operators.sessions import RECIPES, active_sessions, blocked_session_count, isolation_level_text, select_output_columns, session_delta, transaction_log_writes
from fleetlens.operators.waits import wait_info
from fleetlens.plans.ordering import first_per

#: Kilobytes of a page, in which memory is shown.
PAGE_KB = 8
#: What each preset asks for beside the sessions and requests; the sort order is part of its recipe.
NEEDS = {
    "delta": ("texts", "samples"),
    "transactions": ("texts", "transactions"),
    "memory": ("texts", "grants"),
    "tempdb": ("texts", "space_usage", "waiting_tasks"),
    "block_leaders": ("texts", "blocking"),
    "extended": ("texts", "transactions", "grants", "space_usage", "waiting_tasks", "blocking"),
}


def memory_of_requests(grants: DataFrame) -> DataFrame:
    """Per request the memory that was requested, granted, is and was at most in use, in pages, and how long it waited
    for its grant. `grants`: session_id, request_id and kilobytes; several grants of one request add up."""
    keys = [*fleet_keys(grants), "session_id", "request_id"]
    pages = lambda name: int_div(F.sum(f"{name}_memory_kb"), F.lit(PAGE_KB)).alias(f"{name}_memory")
    return grants.groupBy(*keys).agg(pages("used"), pages("max_used"), pages("requested"), pages("granted"), F.max("wait_time_ms").alias("grant_wait_ms"))


def waits_of_sessions(waiting_tasks: DataFrame) -> DataFrame:
    """Per session the texts of all its wait types, in alphabetical order (as many as there are wait types at most)."""
    keys = [*fleet_keys(waiting_tasks), "session_id"]
    return wait_info(waiting_tasks).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("wait_info")), ", ").alias("wait_info"))


def tempdb_of_sessions(space_usage: DataFrame) -> DataFrame:
    """Per session the pages allocated in the temporary database, and those not yet given back."""
    keys = [*fleet_keys(space_usage), "session_id"]
    alloc = F.col("internal_objects_alloc_page_count") + F.col("user_objects_alloc_page_count")
    gone = F.col("internal_objects_dealloc_page_count") + F.col("user_objects_dealloc_page_count")
    return space_usage.groupBy(*keys).agg(F.sum(alloc).alias("tempdb_allocations"), F.sum(alloc - gone).alias("tempdb_current"))


def latest_deltas(samples: DataFrame, metrics: tuple[str, ...], order: tuple[str, ...], bucket: Column | None = None) -> DataFrame:
    """Per session the growth of each metric between the last two samples of its last request."""
    keys = [*fleet_keys(samples), "session_id"]
    grown = session_delta(samples, list(metrics), order, bucket)
    return first_per(grown, keys, [f"-{order[0]}", *order[1:]], [f"{m}_delta" for m in metrics])


def activity_rows(sessions: DataFrame, requests: DataFrame, as_of: Column | str, databases: DataFrame | None = None, texts: DataFrame | None = None,
                  waiting_tasks: DataFrame | None = None, transactions: DataFrame | None = None, grants: DataFrame | None = None, space_usage: DataFrame | None = None,
                  samples: DataFrame | None = None, metrics: tuple[str, ...] = ("cpu", "reads"), sample_order: tuple[str, ...] = ("collected_at",), blocking: bool = False, **filters) -> DataFrame:
    """One row for each request of the sessions worth looking at, and for each of them that has none.

    Every detail is reduced to one row a session or request before it is joined, so no join multiplies rows; details
    that are not given add no columns. The time shown is that of the request, or since `as_of` for a session's oldest
    transaction where it runs nothing. `filters` are those of `active_sessions`.
    """
    keys = fleet_keys(sessions, requests)
    one = [*keys, "session_id"]
    mine = requests.select(*one, "request_id", "command", "start_time", F.col("total_elapsed_time").alias("elapsed_ms"), F.col("cpu_time").alias("cpu"))
    out = active_sessions(sessions, **filters).join(mine, one, "left")
    if "transaction_isolation_level" in sessions.columns:
        out = isolation_level_text(out).drop("transaction_isolation_level")
    if databases is not None:
        names = databases.select(*fleet_keys(sessions, databases), "database_id", F.col("name").alias("database_name"))
        out = out.join(names, [*fleet_keys(sessions, databases), "database_id"], "left").drop("database_id")
        if transactions is not None:
            out = out.join(transaction_log_writes(transactions, databases), one, "left")
    if texts is not None:
        out = out.join(texts.groupBy(*one).agg(F.min("text").alias("sql_text")), one, "left")
    if waiting_tasks is not None:
        out = out.join(waits_of_sessions(waiting_tasks), one, "left")
    if space_usage is not None:
        out = out.join(tempdb_of_sessions(space_usage), one, "left")
    if grants is not None:
        out = out.join(memory_of_requests(grants), [*one, "request_id"], "left")
    if samples is not None:
        out = out.join(latest_deltas(samples, metrics, sample_order), one, "left")
    if blocking:
        out = out.join(blocked_session_count(sessions), one, "left")
    shown = F.col("elapsed_ms")
    if "tran_start_time" in out.columns:
        shown = F.coalesce(shown, F.floor((micros(as_time(as_of)) - micros(F.col("tran_start_time"))) / 1000))
    rest = [c for c in out.columns if c not in keys and c not in ("session_id", "request_id", "elapsed_ms")]
    return out.select(*keys, clock_text(shown).alias("dd_hh_mm_ss_mss"), "session_id", "request_id", *rest)


def activity_preset(name: str, sessions: DataFrame, requests: DataFrame, as_of: Column | str, databases: DataFrame, **details) -> DataFrame:
    """The activity rows of a usual question, with the details it needs (of those given), columns and sort order."""
    needed = {k: v for k, v in details.items() if k in NEEDS[name] or k in ("metrics", "sample_order")}
    columns, sort = RECIPES[name]
    return select_output_columns(activity_rows(sessions, requests, as_of, databases, **needed), columns, sort)
