"""The health check: rules as data, compiled so that every source table is read once.

A rule is text: a source, a condition and four expressions over the columns of that source. All rules of a source become
one array a row, whose findings are exploded; no rule scans for itself, and adding one adds an expression. What a rule
needs from other tables (does a login own the database, when was it backed up) is joined to the source once, as a column.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_time, coded, fleet_keys, ratio
from fleetlens.operators.rules import PAGE_EVENTS, RECOMMENDED, SECURITY_RECOMMENDED, recommended_settings
from fleetlens.plans.joins import join_null_safe
from fleetlens.plans.ordering import first_per


class Rule(NamedTuple):
    """`when` and the four parts of a finding are SQL expressions over the columns of `source`.

    With `each`, the name of an array column, they are taken for every element, which they call `x`.
    """

    source: str
    when: str
    category: str
    sub_category: str
    object_name: str
    details: str
    each: str | None = None


def _says(source: str, when: str, category: str, sub_category: str, object_name: str, details: str, each: str | None = None) -> Rule:
    """A rule whose category and sub-category are plain text."""
    return Rule(source, when, f"'{category}'", f"'{sub_category}'", object_name, details, each)


_SETTING = "concat(x.message, ' (current value: ', x.value, ', recommended value: ', x.recommended_value, ')')"

RULES = (
    # databases
    _says("databases", "is_online AND is_auto_close_on", "General", "closes when idle", "name", "'every reopening costs time and empties its caches; switch it off'"),
    _says("databases", "is_online AND is_auto_shrink_on", "Performance", "shrinks by itself", "name", "'shrinking fragments indexes and files grow again; switch it off'"),
    _says("databases", "is_online AND NOT is_auto_create_stats_on", "Performance", "no statistics are made on demand", "name", "'plans lack row estimates; switch it on'"),
    _says("databases", "is_online AND NOT is_auto_update_stats_on", "Performance", "statistics are not refreshed", "name", "'plans use old row estimates; switch it on'"),
    _says("databases", "is_online AND page_verify_option_desc <> 'CHECKSUM' AND name NOT IN ('model', 'tempdb')", "General", "pages are not verified by checksum", "name", "concat('verified by: ', page_verify_option_desc)"),
    Rule("databases", "compatibility_level <> instance_level", "'Compatibility'", "concat('database level ', compatibility_level, ', instance level ', instance_level)", "name", "'behaves like another version than the instance'"),
    _says("databases", "NOT is_online", "General", "not online", "name", "concat('state: ', state_desc)"),
    _says("databases", "NOT owner_known", "General", "owner unknown", "name", "'no login has the owner\\'s id, as after a restore from elsewhere; name an owner that exists'"),
    _says("databases", "last_backup IS NULL AND name <> 'tempdb'", "Database Backup", "never backed up", "name", "'there is no backup of any kind'"),
    _says("databases", "last_log_backup < as_of - INTERVAL 24 HOURS", "Database Backup", "log backup overdue", "name", "concat('the last one ended at ', date_format(last_log_backup, 'yyyy-MM-dd HH:mm:ss'))"),
    # files
    _says("files", "type IN (0, 1) AND growth = 0", "General", "cannot grow", "physical_name", "'let it grow, up to a maximum'"),
    _says("files", "type IN (0, 1) AND growth > 0 AND is_percent_growth", "Performance", "grows by a share of its size", "physical_name", "concat('by ', growth, ' percent')"),
    _says("files", "upper(physical_name) LIKE 'C:%' AND (database_id > 3 OR database_id = 2) AND database_id <> 32767", "General", "lies on the system volume", "physical_name", "'when it fills that volume, the system stops too'"),
    _says("files", "database_id = 2 AND type = 0 AND temp_growth_kinds > 1", "Performance", "temporary files grow by different steps", "physical_name", "'they are filled in proportion only while they are equal'"),
    # settings
    _says("settings", "(affinity & affinity_io) <> 0", "Performance", "contradicting settings", "'affinity mask'", "'some processors are assigned to queries and to I/O at once'"),
    _says("settings", "blocked_after BETWEEN 1 AND 4", "Performance", "contradicting settings", "'blocked process threshold (s)'", "'a blocking report every 1 to 4 seconds is too frequent; use 0 or at least 5'"),
    _says("settings", "index_kb > 0 AND index_kb < query_kb", "Performance", "contradicting settings", "'index create memory (KB)'", "'building an index may take less memory than any query gets'"),
    _says("settings", "threads > 2048", "Performance", "contradicting settings", "'max worker threads'", "'more than 2048 workers on 64 bits'"),
    _says("settings", "NOT x.security", "General", "unusual instance setting", "x.name", _SETTING, "drifted"),
    _says("settings", "x.security", "Security", "exposed instance setting", "x.name", _SETTING, "drifted"),
    # instances
    _says("facts", "tcp_port = '1433'", "Security", "exposed instance setting", "'TCPIP Port'", "'listens on the well-known port'"),
    _says("facts", "audit_level NOT IN (2, 3)", "Security", "exposed instance setting", "'Failed Logins Auditing'", "'rejected logins leave no trace'"),
    _says("facts", "NOT agent_running AND edition NOT LIKE 'Express%'", "Automation", "Agent Service", "'no agent'", "'nothing scheduled runs and no alert is raised until it is started'"),
    _says("facts", "server_name <> actual_server_name", "General", "registered under another name", "server_name", "concat('the machine\\'s name: ', actual_server_name)"),
    _says("principals", "sid = '0x01' AND name = 'sa' AND NOT is_disabled", "Security", "exposed instance setting", "'SA login'", "'the built-in administrator can log in under its known name'"),
    # query stores
    _says("stores", "query_capture_mode <> 3 AND size_based_cleanup_mode <> 1", "Automation", "Query Store", "database_name", "'captures queries and never removes any'"),
    _says("stores", "(actual_state_desc = 'ERROR' OR desired_state_desc <> actual_state_desc) AND NOT is_secondary", "Automation", "Query Store state", "database_name", "concat('wanted: ', desired_state_desc, ', is: ', actual_state_desc)"),
    # integrity
    _says("suspect_pages", "event_type IN (1, 2, 3)", "Integrity", "suspect page", "concat(database_id, ':', file_id, ':', page_id)", "concat(event_text, ', ', error_count, ' times, last at ', date_format(last_update_date, 'yyyy-MM-dd HH:mm:ss'))"),
    _says("foreign_keys", "is_not_trusted AND NOT is_disabled", "Integrity", "foreign key not trusted", "name", "concat('constraint ', constraint_object_id, ' may be violated by old rows; check it again')"),
    _says("checks", "is_not_trusted AND NOT is_disabled", "Integrity", "check constraint not trusted", "name", "concat('constraint ', constraint_object_id, ' may be violated by old rows; check it again')"),
    # logs
    _says("dumps", "true", "Instance Health", "crash dump", "filename", "concat('written at ', date_format(creation_time, 'yyyy-MM-dd HH:mm:ss'), ' | details: ', replace(filename, '.mdmp', '.txt'))"),
    _says("mail", "event_type = 'error' AND log_date >= since", "Automation", "mail failed", "concat('mail ', mailitem_id)", "concat('reason: ', description)"),
    _says("logs", "megabytes > max_log_mb", "Performance", "error log too large", "concat(log_kind, ' has ', megabytes, ' MB.')", "'start a new log from time to time'"),
)


def compile_rules(sources: dict[str, DataFrame], rules: Sequence[Rule] = RULES) -> DataFrame:
    """The findings of all rules whose source is given: fleet keys, category, sub_category, object_name, details.

    Each source is one projection with one array of findings; the sources' findings are put together by name.
    """
    def parts(rule: Rule) -> str:
        named = zip(("category", "sub_category", "object_name", "details"), (rule.category, rule.sub_category, rule.object_name, rule.details))
        return "named_struct(" + ", ".join(f"'{n}', CAST({e} AS STRING)" for n, e in named) + ")"

    out = []
    for name, frame in sources.items():
        mine = [r for r in rules if r.source == name]
        if not mine:
            continue
        arrays = [F.array(*[F.expr(f"CASE WHEN {r.when} THEN {parts(r)} END") for r in mine if r.each is None])] if any(r.each is None for r in mine) else []
        arrays += [F.expr(f"transform(filter({r.each}, x -> {r.when}), x -> {parts(r)})") for r in mine if r.each is not None]
        found = F.explode(F.filter(F.concat(*arrays), lambda f: f.isNotNull()))
        out.append(frame.select(*fleet_keys(frame), found.alias("f")).select(*fleet_keys(frame), "f.*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


# ---- sources -----------------------------------------------------------------------


def database_source(databases: DataFrame, logins: DataFrame, backupset: DataFrame, as_of: Column | str, instance_level: int = 150) -> DataFrame:
    """Databases with: is_online, instance_level, owner_known, last_backup, last_log_backup, as_of."""
    keys = fleet_keys(databases, logins, backupset)
    owners = logins.select(*keys, F.col("sid").alias("owner_sid")).distinct().withColumn("owner_known", F.lit(True))
    backups = backupset.groupBy(*keys, "database_id").agg(F.max("backup_finish_date").alias("last_backup"), F.max(F.when(F.col("type") == "L", F.col("backup_finish_date"))).alias("last_log_backup"))
    out = join_null_safe(join_null_safe(databases, owners, [*keys, "owner_sid"], "left"), backups, [*keys, "database_id"], "left")
    return out.withColumns({"is_online": F.col("state_desc") == "ONLINE", "owner_known": F.coalesce("owner_known", F.lit(False)), "instance_level": F.lit(instance_level), "as_of": as_time(as_of)})


def file_source(files: DataFrame) -> DataFrame:
    """Files with temp_growth_kinds, how many different steps the temporary database's data files grow by. That needs the
    files of one database next to each other, so these few rows are read a second time, by two columns."""
    keys = fleet_keys(files)
    kinds = files.where("database_id = 2 AND type = 0").select(*keys, "growth", "is_percent_growth").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("temp_growth_kinds"))
    return join_null_safe(files, kinds, keys, "left") if keys else files.withColumn("temp_growth_kinds", kinds.scalar())


def settings_source(config: DataFrame) -> DataFrame:
    """One row a member: the settings that rules compare with each other, and `drifted`, those off their recommended value
    (at most as many as there are recommendations, for each time a setting is given)."""
    keys = fleet_keys(config)
    known = recommended_settings(config.sparkSession, RECOMMENDED).withColumn("security", F.lit(False)).unionByName(
        recommended_settings(config.sparkSession, SECURITY_RECOMMENDED).withColumn("security", F.lit(True)))
    rows = config.join(F.broadcast(known), "name", "left")  # the two fixed lists
    compared = {"affinity mask": "affinity", "affinity I/O mask": "affinity_io", "blocked process threshold (s)": "blocked_after",
                "min memory per query (KB)": "query_kb", "index create memory (KB)": "index_kb", "max worker threads": "threads"}
    off = F.when(F.col("value") != F.col("recommended_value"), F.struct("name", "value", "recommended_value", "message", "security"))
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(a) for n, a in compared.items()], F.collect_list(off).alias("drifted"))


def store_source(options: DataFrame, secondaries: DataFrame) -> DataFrame:
    """Query stores with is_secondary."""
    keys = [*fleet_keys(options, secondaries), "database_name"]
    found = secondaries.select(*keys).distinct().withColumn("is_secondary", F.lit(True))
    return join_null_safe(options, found, keys, "left").withColumn("is_secondary", F.coalesce("is_secondary", F.lit(False)))


def page_source(pages: DataFrame) -> DataFrame:
    return pages.withColumn("event_text", coded("event_type", PAGE_EVENTS))


def mail_source(mail_events: DataFrame, as_of: Column | str, minutes: int = 360) -> DataFrame:
    return mail_events.withColumn("since", as_time(as_of) - F.make_interval(mins=F.lit(minutes)))


def log_source(log_files: DataFrame, max_log_mb: int = 100) -> DataFrame:
    """The current log of each kind, with its megabytes."""
    current = first_per(log_files, [*fleet_keys(log_files), "log_kind"], ["archive_no"])
    return current.withColumns({"megabytes": ratio("size_bytes", F.lit(1048576), 2), "max_log_mb": F.lit(max_log_mb)})
