"""Query statistics, plan cache, query store and running requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import (as_time, c, clock_text, day_clock_text, fleet_keys, int_div, int_div0, minute_boundaries,
                                         one_line, ratio, seconds_between, spoken_duration, statement_text, wide_sum)
from fleetlens.operators.waits import session_top_waits
from fleetlens.plans.joins import join_few
from fleetlens.plans.ordering import add_rank, first_per, reuse, top_n, top_percent
from fleetlens.plans.totals import with_totals

def _order(by: str) -> Column:
    if by.startswith("avg_"):
        return int_div(f"total_{by[4:]}", "execution_count")
    return F.col("execution_count" if by == "executions" else f"total_{by}")


_STATS = ("worker_time", "elapsed_time", "logical_reads", "physical_reads", "logical_writes")


def _measures(columns: Sequence[str]) -> list[Column]:
    out = []
    for s in _STATS:
        if f"total_{s}" in columns:
            out += [F.col(f"total_{s}"), int_div(f"total_{s}", "execution_count").alias(f"avg_{s}")]
        out += [F.col(f"{edge}_{s}") for edge in ("min", "max") if f"{edge}_{s}" in columns]
    return out


def _has_missing_index(plan: str = "query_plan") -> Column:
    return F.coalesce(F.contains(plan, F.lit("<MissingIndexes>")), F.lit(False)).cast("int").alias("has_missing_index")


def top_queries(query_stats: DataFrame, texts: DataFrame, by: str = "worker_time", n: int = 50, plans: DataFrame | None = None) -> DataFrame:
    """The `n` heaviest cached queries by `worker_time`, `logical_reads`,
    `avg_elapsed_time`, `executions`, `physical_reads` or another total.

    The leaders are chosen first; only they are joined to texts and plans.
    """
    keys = fleet_keys(query_stats, texts)
    best = reuse(top_n(query_stats.withColumn("_by", _order(by)), keys, ["-_by", "plan_handle"], n).drop("_by"))
    out = join_few(best, texts.select(*keys, "plan_handle", one_line("text", 255).alias("short_query_text")), [*keys, "plan_handle"])
    flag = []
    if plans is not None:
        asked = join_few(best.select(*keys, "plan_handle"), plans.select(*keys, "plan_handle", "query_plan"), [*keys, "plan_handle"])
        out = out.join(asked, [*keys, "plan_handle"], "left")
        flag = [_has_missing_index()]
    return out.select(*keys, "plan_handle", "database_id", "short_query_text", "execution_count", *_measures(query_stats.columns), *flag, "creation_time")


def top_percent_queries(query_stats: DataFrame, percent: int = 10) -> DataFrame:
    """The slowest `percent` of the queries by average elapsed time."""
    keys = fleet_keys(query_stats)
    timed = query_stats.select(*keys, "plan_handle", "execution_count", "last_execution_time",
                               int_div("total_elapsed_time", "execution_count").alias("_avg"),
                               ratio(int_div("total_elapsed_time", "execution_count"), F.lit(1000), 3).alias("avg_seconds"),
                               ratio("total_elapsed_time", F.lit(1000), 3).alias("total_seconds"))
    return top_percent(timed, keys, ["-_avg", "plan_handle"], percent).drop("_avg")


def top_procedures(proc_stats: DataFrame, procedures: DataFrame, by: str, as_of: Column | str, n: int = 25,
                   plans: DataFrame | None = None, only_missing_index: bool = False) -> DataFrame:
    """Procedure leaderboard by `executions`, `avg_elapsed_time`, `worker_time`,
    `logical_reads`, `physical_reads` or `logical_writes`; plans cached for less
    than one minute boundary are left out."""
    keys = fleet_keys(proc_stats, procedures)
    minutes = minute_boundaries("cached_time", as_time(as_of))
    joined = proc_stats.join(procedures.select(*keys, "object_id", F.col("name").alias("procedure_name")), [*keys, "object_id"])
    joined = joined.withColumn("_minutes", minutes).where(F.col("_minutes") > 0)
    flag = []
    if plans is not None:
        # a plan document stays in its own table until the leaders are known,
        # unless it decides which rows compete
        pl = plans.select(*keys, "plan_handle", _has_missing_index())
        if only_missing_index:
            joined = joined.join(pl.where("has_missing_index = 1").drop("has_missing_index"), [*keys, "plan_handle"], "left_semi")
        else:
            flag = ["has_missing_index"]
    best = top_n(joined.withColumn("_by", _order(by)), keys, ["-_by", "object_id"], n)
    if flag:
        best = join_few(reuse(best), pl, [*keys, "plan_handle"])
    return best.select(
        *keys, "object_id", "procedure_name", "execution_count", int_div0("execution_count", "_minutes").alias("calls_per_minute"),
        *_measures(proc_stats.columns), *flag,
        F.date_format("last_execution_time", "yyyy-MM-dd HH:mm:ss").alias("last_execution_time"),
        F.date_format("cached_time", "yyyy-MM-dd HH:mm:ss").alias("plan_cached_time"))


def procedures_missing_index(proc_stats: DataFrame, procedures: DataFrame, plans: DataFrame, as_of: Column | str, n: int = 25) -> DataFrame:
    """The most executed procedures whose plan asks for an index."""
    return top_procedures(proc_stats, procedures, "executions", as_of, n, plans, only_missing_index=True)


def cpu_share_by_database(query_stats: DataFrame, plan_attributes: DataFrame | None = None, resource_database: int = 32767) -> DataFrame:
    """CPU milliseconds per database, rank and share; the resource database takes no part."""
    keys = fleet_keys(query_stats)
    stats = query_stats
    if plan_attributes is not None:
        stats = query_stats.drop("database_id").join(plan_attributes.select(*keys, "plan_handle", "database_id"), [*keys, "plan_handle"])
    per = stats.groupBy(*keys, "database_id").agg(F.sum(int_div("total_worker_time", F.lit(1000))).alias("cpu_time_ms"))
    per = reuse(per.where(F.col("database_id") != resource_database))
    ranked = add_rank(per, keys, ["-cpu_time_ms", "database_id"], "cpu_rank")
    ranked = with_totals(ranked, keys, {"_all": wide_sum("cpu_time_ms")}, per)
    return ranked.select(*keys, "cpu_rank", "database_id", "cpu_time_ms", ratio("cpu_time_ms", "_all", 2, 100).alias("cpu_pct"))


def add_statement_text(texts: DataFrame) -> DataFrame:
    """Add the statement that the offsets of each row mark in its text."""
    return texts.withColumn("statement", statement_text("text", "statement_start_offset", "statement_end_offset"))


def top_io_statements(query_stats: DataFrame, texts: DataFrame, n: int = 50) -> DataFrame:
    """The statements with the most reads and writes per execution."""
    keys = fleet_keys(query_stats, texts)
    per = query_stats.withColumn("avg_io", int_div(F.col("total_logical_reads") + F.col("total_logical_writes"), "execution_count"))
    best = reuse(top_n(per, keys, ["-avg_io", "plan_handle"], n))
    out = join_few(best, texts, [*keys, "plan_handle"])
    text = statement_text("text", "statement_start_offset", "statement_end_offset") if "statement_start_offset" in out.columns else F.col("text")
    return out.select(*keys, "plan_handle", "avg_io", "execution_count", text.alias("query_text"))


def single_use_plans(cached_plans: DataFrame, n: int = 50) -> DataFrame:
    """The largest compiled ad hoc and prepared plans that were used once."""
    keys = fleet_keys(cached_plans)
    once = cached_plans.where((F.col("usecounts") == 1) & F.col("objtype").isin("Adhoc", "Prepared"))
    if "cacheobjtype" in cached_plans.columns:
        once = once.where(F.col("cacheobjtype") == "Compiled Plan")
    return top_n(once, keys, ["-size_in_bytes", "plan_handle"], n).select(
        *keys, "plan_handle", "objtype", int_div("size_in_bytes", F.lit(1024)).alias("plan_size_kb"), F.col("text").alias("query_text"))


def adhoc_plan_ratio(cached_plans: DataFrame, config: DataFrame, min_mb: int = 200, min_pct: int = 25) -> DataFrame:
    """Advice to switch the ad hoc optimisation on or off, from the memory its plans take."""
    keys = fleet_keys(cached_plans, config)
    once = (F.col("usecounts") == 1) & (F.lower("objtype") == "adhoc")
    sums = cached_plans.groupBy(*keys).agg(F.sum(F.when(once, F.col("size_in_bytes")).otherwise(0)).cast("decimal(28,0)").alias("_adhoc"), wide_sum("size_in_bytes").alias("_all"))
    setting = config.where(F.lower("name") == "optimize for ad hoc workloads").groupBy(*keys).agg(F.max("value").alias("_on"))
    joined = sums.join(setting, keys) if keys else sums.withColumn("_on", setting.scalar())
    much_mb, limit = F.col("_adhoc") > min_mb * 1048576, F.col("_all") * min_pct
    much_pct = F.col("_adhoc") * 100 > limit
    little = (F.col("_adhoc") < min_mb * 1048576) & (F.col("_adhoc") * 100 < limit)
    # the stated rule: on and large -> "off" advice; off and small -> "on" advice
    details = (F.when((F.col("_on") == 1) & (much_mb | much_pct), "plan stubs are on although such plans take little worth saving; switch them off")
               .when((F.col("_on") == 0) & little, "plan stubs are off; switch them on"))
    return joined.select(*keys, ratio("_adhoc", F.lit(1048576), 2).alias("adhoc_mb"), ratio("_all", F.lit(1048576), 2).alias("total_mb"),
                         ratio("_adhoc", "_all", 2, 100).alias("adhoc_pct"), details.alias("details")).where(F.col("details").isNotNull())


def _strip(col: str) -> Column:
    return F.regexp_replace(F.replace(F.coalesce(col, F.lit("")), F.lit(", "), F.lit("_")), r"[\[\]]", "")


def missing_index_advice(missing: DataFrame, formula: str = "advantage", n: int | None = None, minimum: int = 10, partitions: DataFrame | None = None) -> DataFrame:
    """Missing indexes with their benefit and the statement that would create them.

    `advantage` = seeks * cost * impact %; `improvement` = cost * impact *
    (seeks + scans), kept above `minimum`. Next to each row stands how many are
    suggested for the table and for the table with the same equality columns.
    """
    keys = fleet_keys(missing)
    if formula == "advantage":
        value = F.round(F.col("user_seeks") * F.col("avg_total_user_cost") * F.col("avg_user_impact")) / 100
    else:
        value = F.round(F.col("avg_total_user_cost") * F.col("avg_user_impact") * (F.col("user_seeks") + F.col("user_scans")) * 10) / 10
    out = missing.withColumn("benefit", value)
    if formula != "advantage":
        out = out.where(F.col("benefit") > minimum)
    per_table = missing.groupBy(*keys, "statement").agg(F.count(F.lit(1)).alias("missing_for_table"))
    eq = F.coalesce("equality_columns", F.lit("\0"))
    per_columns = missing.withColumn("_eq", eq).groupBy(*keys, "statement", "_eq").agg(F.count(F.lit(1)).alias("similar_missing"))
    if n is not None:
        out = top_n(out, keys, ["-benefit", "group_handle"], n)
    out = out.join(per_table, [*keys, "statement"]).withColumn("_eq", eq).join(per_columns, [*keys, "statement", "_eq"])
    if partitions is not None:
        rows = partitions.where(F.col("index_id") < 2).groupBy(*fleet_keys(partitions), "statement").agg(F.sum("row_count").alias("table_rows"))
        out = out.join(rows, [*keys, "statement"], "left")
    both = F.when(F.col("equality_columns").isNotNull() & F.col("inequality_columns").isNotNull(), F.lit(1))
    create = F.concat(
        F.lit("CREATE NONCLUSTERED INDEX [IX_"), _strip("statement"), F.lit("_"), _strip("equality_columns"),
        F.when(both == 1, "_").otherwise(""), _strip("inequality_columns"), F.lit("] ON "), F.col("statement"), F.lit(" ("),
        F.coalesce("equality_columns", F.lit("")), F.when(both == 1, ",").otherwise(""), F.coalesce("inequality_columns", F.lit("")), F.lit(")"),
        F.coalesce(F.concat(F.lit(" INCLUDE ("), F.col("included_columns"), F.lit(")")), F.lit("")) if "included_columns" in missing.columns else F.lit(""))
    return out.select(*keys, "group_handle", "benefit", "statement", "equality_columns", "inequality_columns", "user_seeks", "user_scans",
                      "avg_total_user_cost", "avg_user_impact", "last_user_seek", "missing_for_table", "similar_missing",
                      *(["table_rows"] if partitions is not None else []), create.alias("create_index_statement"))


def missing_index_plans(cached_plans: DataFrame, plans: DataFrame, n: int = 25) -> DataFrame:
    """The most used plans that mention a missing index."""
    keys = [*fleet_keys(cached_plans, plans), "plan_handle"]
    asking = plans.where(F.contains("query_plan", F.lit("MissingIndex"))).select(*keys)
    hits = cached_plans.join(asking, keys, "left_semi")
    return top_n(hits, keys[:-1], ["-usecounts", "plan_handle"], n).select(*keys, "objtype", "usecounts", "size_in_bytes")


def function_stats(stats: DataFrame, n: int = 25) -> DataFrame:
    """Scalar functions by total CPU."""
    keys = fleet_keys(stats)
    return top_n(stats, keys, ["-total_worker_time", "object_id"], n).select(
        *keys, "object_id", "total_worker_time", "execution_count", "total_elapsed_time",
        int_div("total_elapsed_time", "execution_count").alias("avg_elapsed_time"), "last_execution_time", "cached_time")


def inlineable_functions(modules: DataFrame, stats: DataFrame) -> DataFrame:
    """Inlining flags of the scalar functions that ran."""
    keys = [*fleet_keys(modules, stats), "object_id"]
    ran = stats.where(F.col("type_desc") == "SQL_SCALAR_FUNCTION").select(*keys)
    return modules.select(*keys, "name", "is_inlineable", "inline_type").join(ran, keys)


def query_store_top_duration(runtime: DataFrame, plans: DataFrame, as_of: Column | str, hours: int = 1, n: int = 50) -> DataFrame:
    """The queries with the most total duration of the last hours, one row per plan of each."""
    keys = fleet_keys(runtime, plans)
    recent = runtime.where((F.col("start_time") >= as_time(as_of) - F.make_interval(hours=F.lit(hours))) & (F.col("execution_type_desc") == "Regular"))
    # one row per (query, plan) first: the distinct count then combines on the map side
    per_plan = recent.groupBy(*keys, "query_id", "plan_id").agg(F.sum(F.col("count_executions") * F.col("avg_duration")).alias("d"))
    per = per_plan.groupBy(*keys, "query_id").agg(F.sum("d").alias("total_duration"), F.count(F.lit(1)).alias("plan_count"))
    best = reuse(top_n(per, keys, ["-total_duration", "query_id"], n, "duration_rank"))
    return join_few(best, plans, [*keys, "query_id"], "inner")


def queries_using_index(query_stats: DataFrame, plans: DataFrame, index_name: str) -> DataFrame:
    """Cached queries whose plan mentions an index."""
    keys = [*fleet_keys(query_stats, plans), "plan_handle"]
    hits = plans.where(F.contains("query_plan", F.lit(index_name))).select(*keys)
    return query_stats.join(hits, keys, "left_semi")


def store_queries_using_index(runtime: DataFrame, plans: DataFrame, index_name: str) -> DataFrame:
    """Query-store executions of the queries whose plan mentions an index.

    `est_duration` is executions times the plain average of the averages, as
    commonly reported; `exact_duration` weights every average by its executions.
    """
    keys = fleet_keys(runtime, plans)
    hits = plans.where(F.contains("query_plan", F.lit(index_name))).select(*keys, "query_id", "plan_id")
    per = runtime.join(hits, [*keys, "query_id", "plan_id"]).groupBy(*keys, "query_id").agg(
        F.sum("count_executions").alias("execution_count"), F.count(F.lit(1)).alias("_n"), F.sum("avg_duration").alias("_avg"),
        F.sum(F.col("count_executions") * F.col("avg_duration")).alias("exact_duration"),
        F.min("start_time").alias("min_execution_time"), F.max("start_time").alias("last_execution_time"), F.max("plan_id").alias("latest_plan_id"))
    return per.withColumn("est_duration", ratio(F.col("execution_count") * F.col("_avg"), "_n", 2)).drop("_n", "_avg")


def forced_index_plans(query_stats: DataFrame, texts: DataFrame, plans: DataFrame) -> DataFrame:
    """Queries that force an index: the plan says so and the text names one."""
    keys = [*fleet_keys(query_stats, texts, plans), "plan_handle"]
    forced = plans.where(F.contains("query_plan", F.lit('ForcedIndex="1"'))).select(*keys)
    named = texts.where(F.contains(F.upper("text"), F.lit("INDEX")))
    return query_stats.join(forced, keys, "left_semi").join(named.select(*keys, "text"), keys)


PROGRESS_OPERATORS = ("Table Scan", "Clustered Index Scan", "Sort", "Index Insert", "Index Scan")


def progress_eta(query_profiles: DataFrame, as_of: Column | str) -> DataFrame:
    """Rows done and left of each session's running statement, and when it should end."""
    keys = [*fleet_keys(query_profiles), "session_id"]
    current = F.when((F.col("close_time") == 0) & (F.col("first_row_time") > 0), F.col("physical_operator_name")).otherwise("")
    per = query_profiles.where(F.col("physical_operator_name").isin(*PROGRESS_OPERATORS)).groupBy(*keys).agg(
        F.sum("row_count").alias("rows_processed"), F.sum("estimate_row_count").alias("total_rows"),
        (F.max("last_active_time") - F.min("first_active_time")).alias("elapsed_ms"), F.max(current).alias("current_step"))
    left = F.col("total_rows") - F.col("rows_processed")
    seconds = int_div(wide_product("elapsed_ms", left), F.col("rows_processed") * 1000)
    return per.select(
        *keys, "current_step", "total_rows", "rows_processed", left.alias("rows_left"), ratio("rows_processed", "total_rows", 2, 100).alias("percent_complete"),
        ratio("elapsed_ms", F.lit(1000), 3).alias("elapsed_seconds"), seconds.alias("estimated_seconds_left"),
        F.timestamp_add("SECOND", seconds, as_time(as_of)).alias("estimated_completion_time"))


def wide_product(a: Column | str, b: Column | str) -> Column:
    return c(a).cast("decimal(19,0)") * c(b).cast("decimal(19,0)")


def backup_restore_progress(requests: DataFrame, as_of: Column | str,
                            commands: Sequence[str] = ("RESTORE DATABASE", "BACKUP DATABASE", "RESTORE LOG", "BACKUP LOG")) -> DataFrame:
    """Running time and time to go of running backups and restores."""
    keys = [*fleet_keys(requests), "session_id", "request_id"]
    now, eta = as_time(as_of), F.col("estimated_completion_time")
    return requests.where(F.col("command").isin(*commands)).select(
        *keys, "command", *[x for x in ("percent_complete",) if x in requests.columns],
        spoken_duration(seconds_between("start_time", now)).alias("running_time"),
        spoken_duration(int_div(eta, F.lit(1000))).alias("est_time_to_go"),
        F.timestamp_add("SECOND", int_div(eta, F.lit(1000)), now).alias("est_completion_time"))


def current_requests(requests: DataFrame, sessions: DataFrame, texts: DataFrame | None = None, by: str = "cpu_time", n: int | None = None) -> DataFrame:
    """Running requests with session facts and statement, by CPU or elapsed time."""
    keys = fleet_keys(requests, sessions)
    rows = requests
    if "wait_type" in requests.columns:
        rows = rows.where(F.coalesce(~F.col("wait_type").startswith("SP_SERVER_DIAGNOSTICS"), F.lit(True)))
    if n is not None:
        # every request has a session, so the leaders can be chosen before the join
        rows = top_n(rows.join(sessions.select(*keys, "session_id"), [*keys, "session_id"], "left_semi"), keys, [f"-{by}", "request_id"], n)
    mine = [x for x in ("login_name", "host_name", "program_name", "login_time") if x in sessions.columns]
    out = rows.join(sessions.select(*keys, "session_id", *mine), [*keys, "session_id"])
    if texts is not None:
        out = out.join(texts, [*keys, "sql_handle"], "left").withColumn("statement", statement_text("text", "statement_start_offset", "statement_end_offset")).drop("text")
    return out.withColumn("elapsed_time", day_clock_text("total_elapsed_time"))


def connections_by_client(sessions: DataFrame, connections: DataFrame) -> DataFrame:
    """Connections per client address, program, host and login."""
    keys = fleet_keys(sessions, connections)
    # count per session and address first: one busy session then travels as one row
    per = connections.groupBy(*keys, "session_id", "client_net_address").agg(F.count(F.lit(1)).alias("n"))
    joined = per.join(sessions.select(*keys, "session_id", "program_name", "host_name", "login_name"), [*keys, "session_id"])
    return joined.groupBy(*keys, "client_net_address", "program_name", "host_name", "login_name").agg(F.sum("n").alias("connection_count"))


def input_buffers(sessions: DataFrame, buffers: DataFrame, min_session: int = 50, own_session: int | None = None) -> DataFrame:
    """The last command of every user session."""
    keys = [*fleet_keys(sessions, buffers), "session_id"]
    users = sessions.where(F.col("session_id") > min_session)
    if own_session is not None:
        users = users.where(F.col("session_id") != own_session)
    return users.join(buffers.select(*keys, F.col("event_info").alias("input_buffer")), keys, "left")


def task_profile(tasks: DataFrame, profiles: DataFrame, waiting_tasks: DataFrame, session_waits: DataFrame) -> DataFrame:
    """Tasks with their plan node, their longest current wait and the session's top waits."""
    keys = fleet_keys(tasks, profiles, waiting_tasks, session_waits)
    task = [*keys, "session_id", "task_id"]
    longest = first_per(waiting_tasks.select(*task, "wait_type", "wait_duration_ms"), task, ["-wait_duration_ms", "wait_type"])
    return (tasks.withColumn("is_parent", F.col("parent_task_id").isNull().cast("int"))
            .join(profiles.select(*task, "node_id", "row_count", "physical_operator_name"), task, "left")
            .join(longest, task, "left").join(session_top_waits(session_waits), [*keys, "session_id"], "left"))


def elapsed_texts(requests: DataFrame) -> DataFrame:
    """Add the elapsed time as `dd hh:mm:ss.mss`."""
    return requests.withColumn("elapsed_text", clock_text("total_elapsed_time"))
