"""Plans, ring buffers and event files: rows out of XML documents.

Every operator keeps only documents that contain the wanted element before it
parses any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_time, fleet_keys
from fleetlens.plans.ordering import first_per, top_n
from fleetlens.plans.trees import attribute, below, nodes

# ---- plans -----------------------------------------------------------------------


def parallel_plans_below_cost(cached_plans: DataFrame, plans: DataFrame, min_use: int = 50, max_cost: float = 30) -> DataFrame:
    """Statements that run in parallel although they are cheap, one row per statement
    text: that of the most used plan."""
    keys = fleet_keys(cached_plans, plans)
    used = cached_plans.where(F.col("usecounts") > min_use).select(*keys, "plan_handle", "usecounts", "size_in_bytes")
    docs = plans.where(F.contains("query_plan", F.lit('PhysicalOp="Parallelism"')))
    parallel = "/ShowPlanXML/BatchSequence/Batch/Statements/StmtSimple[@StatementText and @StatementSubTreeCost][.//RelOp[@PhysicalOp='Parallelism']]"
    pairs = F.arrays_zip(F.xpath("query_plan", F.lit(f"{parallel}/@StatementText")).alias("text"), F.xpath("query_plan", F.lit(f"{parallel}/@StatementSubTreeCost")).alias("cost"))
    # documents are read where they are scanned; only statements meet the cached plans
    rows = docs.select(*keys, "plan_handle", F.explode(pairs).alias("s")).select(
        *keys, "plan_handle", F.col("s.text").alias("statement_text"), F.col("s.cost").cast("double").alias("subtree_cost")).where(F.col("subtree_cost") <= max_cost)
    rows = rows.join(used, [*keys, "plan_handle"]).select(*keys, "plan_handle", "usecounts", "size_in_bytes", "statement_text", "subtree_cost")
    return first_per(rows, [*keys, "statement_text"], ["-usecounts", "plan_handle"])


_BARE = r"^\[|\]$"
#: Schemas whose columns the searches leave out.
_NO_USER_SCHEMA = "[sys]"


def _statement_nodes(docs: DataFrame, keys: list[str], names: tuple[str, ...]) -> tuple[DataFrame, list[str], DataFrame]:
    """All nodes of the names, the columns that tell a document, and its statements with their text."""
    found = nodes(docs, [*keys, "plan_handle"], "query_plan", ("StmtSimple", *names))
    one = [*keys, "plan_handle", "_text"]
    statements = found.where("name = 'StmtSimple'").select(*one, "_copies", "entry", "leave", "level", attribute("tag", "StatementText").alias("text"))
    return found, one, statements


def _column(tag: str) -> list[Column]:
    return [attribute(tag, "Schema").alias("schema_name"), attribute(tag, "Table").alias("table_name"), attribute(tag, "Column").alias("column_name"), attribute(tag, "Database").alias("database_name")]


def _user_column(schema: str = "schema_name") -> Column:
    return F.col(schema).isNotNull() & (F.col(schema) != _NO_USER_SCHEMA)


def implicit_conversions(plans: DataFrame, columns: DataFrame, database: str | None = None) -> DataFrame:
    """Every implicit conversion of a column, with its declared type and the type it is converted to.

    `columns`: schema_name, table_name, column_name, data_type, max_length. With `database`, only columns of that database.
    A conversion is of the first column that stands by itself under it; a statement within a statement counts for both.
    """
    keys = fleet_keys(plans, columns)
    docs = plans.where(F.contains("query_plan", F.lit('Implicit="1"')) | F.contains("query_plan", F.lit('Implicit="true"'))).select(*keys, "plan_handle", "query_plan")
    found, one, statements = _statement_nodes(docs, keys, ("Convert", "ScalarOperator", "Identifier", "ColumnReference"))
    place = [*one, "entry", "leave", "level"]
    converts = found.where("name = 'Convert'").where(attribute("tag", "Implicit").isin("1", "true")).select(
        *place, attribute("tag", "DataType").alias("type"), attribute("tag", "Length").try_cast("int").alias("length"))
    # Convert, ScalarOperator, Identifier, ColumnReference: each the parent of the next
    operators = below(converts, found.where("name = 'ScalarOperator'").select(*place), one, "c", "s", levels=1)
    operators = operators.select(*one, "c_entry", "c_type", "c_length", *[F.col(f"s_{x}").alias(x) for x in ("entry", "leave", "level")])
    names_ = below(operators, found.where("name = 'Identifier'").select(*place), one, "o", "i", levels=1)
    names_ = names_.select(*one, "o_c_entry", "o_c_type", "o_c_length", *[F.col(f"i_{x}").alias(x) for x in ("entry", "leave", "level")])
    direct = below(names_, found.where("name = 'ColumnReference'").select(*place, "tag"), one, "n", "r", levels=1)
    first = direct.groupBy(*one, F.col("n_o_c_entry").alias("entry")).agg(F.min_by(F.struct("r_tag", F.col("n_o_c_type").alias("type"), F.col("n_o_c_length").alias("length")), "r_entry").alias("f"))
    first = first.select(*one, "entry", "f.type", "f.length", *_column("f.r_tag")).where(_user_column())
    if database is not None:
        first = first.where(F.col("database_name") == f"[{database}]")
    in_statement = below(statements, first, one, "s", "c")
    rows = in_statement.select(*keys, "plan_handle", F.explode(F.sequence(F.lit(1), F.col("s__copies"))).alias("_copy"), F.col("s_text").alias("statement"),
                               *[F.regexp_replace(f"c_{x}", _BARE, "").alias(x) for x in ("schema_name", "table_name", "column_name")],
                               F.col("c_type").alias("convert_to"), F.col("c_length").alias("convert_to_length")).drop("_copy")
    declared = columns.select(*keys, "schema_name", "table_name", "column_name", F.col("data_type").alias("convert_from"), F.col("max_length").alias("convert_from_length"))
    return rows.join(declared, [*keys, "schema_name", "table_name", "column_name"])


def non_sargable_scans(plans: DataFrame, database: str | None = None) -> DataFrame:
    """Table and index scans whose predicate wraps a column in an expression; with `database`, columns of that database.

    An expression anywhere below an operator that scans is named by its first column, if one of its columns is a user's.
    """
    keys = fleet_keys(plans)
    docs = plans.where((F.contains("query_plan", F.lit("<TableScan")) | F.contains("query_plan", F.lit("<IndexScan"))) & F.contains("query_plan", F.lit("ScalarString"))).select(*keys, "plan_handle", "query_plan")
    found, one, statements = _statement_nodes(docs, keys, ("RelOp", "TableScan", "IndexScan", "ScalarOperator", "Identifier", "ColumnReference"))
    place = [*one, "entry", "leave", "level"]
    operators, scans = found.where("name = 'RelOp'").select(*place), found.where("name IN ('TableScan', 'IndexScan')").select(*place, "name")
    inside = below(operators, scans, one, "r", "s")
    scanning = inside.groupBy(*one, F.col("r_entry").alias("entry"), F.col("r_leave").alias("leave"), F.col("r_level").alias("level")).agg(
        F.max(F.col("s_level") == F.col("r_level") + 1).alias("direct"), F.max("s_name").alias("kind")).where("direct")
    texts = found.where("name = 'ScalarOperator'").select(*place, attribute("tag", "ScalarString").alias("text")).where("text <> ''")
    identifiers = found.where("name = 'Identifier'").select(*place)
    references = below(identifiers, found.where("name = 'ColumnReference'").select(*place, "tag"), one, "i", "c", levels=1)
    references = references.select(*one, F.col("i_entry").alias("entry"), F.col("i_level").alias("level"), F.col("c_entry").alias("at"), F.struct(*_column("c_tag")).alias("column"))
    # an operator's columns come by their identifiers, which lie below it
    owned = below(texts, references, one, "t", "r")
    users = _user_column("r_column.schema_name") & F.col("r_column.database_name").isNotNull()
    if database is not None:
        users = users & (F.col("r_column.database_name") == f"[{database}]")
    wrapped = owned.groupBy(*one, F.col("t_entry").alias("entry"), F.col("t_leave").alias("leave"), F.col("t_level").alias("level"), F.col("t_text").alias("text")).agg(
        F.max(users).alias("of_user"), F.min_by("r_column", F.struct("r_entry", "r_at")).alias("column")).where("of_user").drop("of_user")
    scanned = below(scanning, wrapped, one, "r", "x").select(*one, F.col("r_entry").alias("entry"), F.col("r_level").alias("level"), "r_kind", "x_text", "x_column")
    out = below(statements, scanned, one, "s", "x")
    return out.select(*keys, "plan_handle", F.explode(F.sequence(F.lit(1), F.col("s__copies"))).alias("_copy"), F.col("s_text").alias("statement"),
                      *[F.col(f"x_x_column.{x}").alias(x) for x in ("schema_name", "table_name", "column_name")],
                      F.col("x_r_kind").alias("scan_type"), F.col("x_x_text").alias("scalar_string")).drop("_copy")


def table_variable_plans(cached_plans: DataFrame, plans: DataFrame, texts: DataFrame, objects_with_table_params: DataFrame, unreadable_databases: DataFrame) -> DataFrame:
    """Procedures whose plans use table variables, with plan and use counts. Left out:
    procedures that take table parameters, and databases of unreadable replicas."""
    keys = fleet_keys(cached_plans, plans, texts, objects_with_table_params, unreadable_databases)
    docs = plans.where(F.contains("query_plan", F.lit('Table="[@'))).where(F.xpath_boolean("query_plan", F.lit("boolean(//Object[substring(@Table,1,2)='[@'])"))).select(*keys, "plan_handle")
    procs = cached_plans.where(F.col("objtype") == "Proc").join(docs, [*keys, "plan_handle"], "left_semi").select(*keys, "plan_handle", "usecounts")
    named = procs.join(texts.select(*keys, "plan_handle", "database_id", "object_id"), [*keys, "plan_handle"]).where(F.col("database_id") > 4)
    kept = named.join(objects_with_table_params.select(*keys, "database_id", "object_id"), [*keys, "database_id", "object_id"], "left_anti").join(
        unreadable_databases.select(*keys, "database_id"), [*keys, "database_id"], "left_anti")
    return kept.groupBy(*keys, "database_id", "object_id").agg(F.count(F.lit(1)).alias("plan_count"), F.sum("usecounts").alias("total_use_count"))


# ---- ring buffers ------------------------------------------------------------------

_HEALTH = "_id BIGINT, SchedulerMonitorEvent STRUCT<SystemHealth: STRUCT<ProcessUtilization: INT, SystemIdle: INT>>"


def cpu_history(ring_buffer: DataFrame, as_of: Column | str, as_of_ticks: Column | int, n: int = 256) -> DataFrame:
    """The newest `n` scheduler records: server process, idle and other CPU percent, and when."""
    keys = fleet_keys(ring_buffer)
    docs = ring_buffer.where((F.col("ring_buffer_type") == "RING_BUFFER_SCHEDULER_MONITOR") & F.contains("record", F.lit("<SystemHealth>")))
    parsed = docs.select(*keys, "timestamp", F.from_xml("record", F.lit(_HEALTH)).alias("r"))
    ticks = F.lit(as_of_ticks) if isinstance(as_of_ticks, int) else as_of_ticks
    health = "r.SchedulerMonitorEvent.SystemHealth"
    rows = parsed.select(*keys, F.col("r._id").alias("record_id"), F.col(f"{health}.ProcessUtilization").alias("process_utilization"), F.col(f"{health}.SystemIdle").alias("system_idle"),
                         F.timestamp_add("MILLISECOND", -(ticks - F.col("timestamp")), as_time(as_of)).alias("event_time"))
    rows = rows.withColumn("other_utilization", F.lit(100) - F.col("system_idle") - F.col("process_utilization"))
    return top_n(rows, keys, ["-record_id"], n)


def low_memory_notifications(ring_buffer: DataFrame, as_of: Column | str, as_of_ticks: int, minutes: int = 360) -> DataFrame:
    """Members that reported low host memory in the window, with how often."""
    keys = fleet_keys(ring_buffer)
    recent = ring_buffer.where((F.col("ring_buffer_type") == "RING_BUFFER_RESOURCE_MONITOR") & (F.lit(as_of_ticks) - F.col("timestamp") < minutes * 60000) & F.contains("record", F.lit("<IndicatorsSystem>2<")))
    low = recent.where(F.xpath_int("record", F.lit("Record/ResourceMonitor/IndicatorsSystem")) == 2)
    return low.groupBy(*keys).agg(F.count(F.lit(1)).alias("notifications"), F.timestamp_add("MILLISECOND", F.max("timestamp") - F.lit(as_of_ticks), as_time(as_of)).alias("last_time")).where(F.col("notifications") > 0)


# ---- event files ---------------------------------------------------------------------

_DEADLOCK = """_timestamp STRING, data STRUCT<value: STRUCT<deadlock: STRUCT<`victim-list`: STRUCT<victimProcess: ARRAY<STRUCT<_id: STRING>>>,
    `process-list`: STRUCT<process: ARRAY<STRUCT<_id: STRING, _hostname: STRING, _clientapp: STRING, _currentdb: INT, _transactionname: STRING, _isolationlevel: STRING>>>>>>"""


def deadlock_events(events: DataFrame, databases: DataFrame) -> DataFrame:
    """Deadlock reports with what is known of the victim."""
    keys = fleet_keys(events, databases)
    docs = events.where(F.contains("event_xml", F.lit('name="xml_deadlock_report"'))).select(*keys, "event_id", "event_xml", F.from_xml("event_xml", F.lit(_DEADLOCK)).alias("e"))
    graph = "e.data.value.deadlock"
    victim = F.filter(F.col(f"{graph}.process-list.process"), lambda p: p["_id"] == F.col(f"{graph}.victim-list.victimProcess")[0]["_id"])[0]
    rows = docs.withColumn("v", victim).select(
        *keys, "event_id", F.col("e._timestamp").try_cast("timestamp_ntz").alias("event_time"), F.col("v._hostname").alias("host_name"), F.col("v._clientapp").alias("client_app"),
        F.col("v._currentdb").alias("database_id"), F.col("v._transactionname").alias("transaction_name"), F.col("v._isolationlevel").alias("isolation_level"), F.col("event_xml").alias("graph"))
    return rows.join(databases.select(*keys, "database_id", F.col("name").alias("database_name")), [*keys, "database_id"], "left")


_EVENT = "_name STRING, _timestamp STRING, data ARRAY<STRUCT<_name: STRING, value: STRING, text: STRING>>"


def parse_events(events: DataFrame) -> DataFrame:
    """Event name, time and a map from data name to its text or value."""
    parsed = events.withColumn("_e", F.from_xml("event_xml", F.lit(_EVENT)))
    entries = F.transform("_e.data", lambda d: F.struct(d["_name"].alias("k"), F.coalesce(d["text"], d["value"]).alias("v")))
    return parsed.select(*[x for x in events.columns if x != "event_xml"], F.col("_e._name").alias("event_name"), F.col("_e._timestamp").alias("event_timestamp"), F.map_from_entries(entries).alias("data"))


def replica_state_changes(events: DataFrame, replicas: DataFrame, utc_shift_hours: int = 0) -> DataFrame:
    """Changes of replica state with the replica's name, times shifted from UTC."""
    keys = fleet_keys(events, replicas)
    rows = parse_events(events.where(F.contains("event_xml", F.lit('name="availability_replica_state_change"'))))
    time = F.timestamp_add("HOUR", F.lit(utc_shift_hours), F.col("event_timestamp").try_cast("timestamp_ntz"))
    rows = rows.select(*keys, "event_id", time.alias("event_time"), F.col("data")["availability_group_name"].alias("group_name"), F.col("data")["previous_state"].alias("previous_state"),
                       F.col("data")["current_state"].alias("current_state"), F.col("data")["availability_replica_id"].cast("bigint").alias("replica_id"))
    return rows.join(replicas.select(*keys, "replica_id", "replica_name"), [*keys, "replica_id"])


def ha_errors(events: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Reported errors with number and message, and their severity where a message catalog is given."""
    keys = fleet_keys(events)
    rows = parse_events(events.where(F.contains("event_xml", F.lit('name="error_reported"'))))
    out = rows.select(*keys, "event_id", F.col("event_timestamp").try_cast("timestamp_ntz").alias("event_time"), F.col("data")["error_number"].cast("int").alias("error_number"), F.col("data")["message"].alias("message"))
    if catalog is None:
        return out
    # message numbers mean the same on every member
    texts = catalog.select(F.col("message_id").alias("error_number"), "severity").distinct()
    return out.join(texts, "error_number", "left")
