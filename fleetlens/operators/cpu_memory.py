"""Processor and memory: counters, buffer pool, topology and sizing advice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_time, fleet_keys, int_div, minute_boundaries, ratio, wide, wide_sum
from fleetlens.plans.checkpoints import cut
from fleetlens.plans.joins import join_grown
from fleetlens.plans.ordering import add_rank, reuse, top_n
from fleetlens.plans.sequences import with_previous
from fleetlens.plans.totals import with_totals


def cpu_recent_averages(cpu_history: DataFrame, windows: Sequence[int] = (5, 10, 15, 30), value: str = "process_utilization",
                        order: Sequence[str] = ("-event_time",)) -> DataFrame:
    """Average of the newest 5, 10, 15 and 30 samples (whole numbers), in one pass over the newest 30."""
    keys = fleet_keys(cpu_history)
    newest = top_n(cpu_history, keys, list(order), max(windows), "_n")
    return newest.groupBy(*keys).agg(*[
        int_div(F.sum(F.when(F.col("_n") <= w, F.col(value))), F.sum((F.col("_n") <= w).cast("int"))).alias(f"avg_{w}") for w in windows])


def cpu_percent_between(request_snapshots: DataFrame, schedulers: DataFrame, bucket: Column | None = None) -> DataFrame:
    """CPU time that requests used between two snapshots, as percent of what the online schedulers could give."""
    keys = fleet_keys(request_snapshots, schedulers)
    per = request_snapshots.groupBy(*keys, "collected_at").agg(F.sum("cpu_time").alias("cpu_time"))
    per = with_previous(per, keys, ["collected_at"], ["cpu_time", "collected_at"], F.to_date("collected_at") if bucket is None else bucket)
    cpus = schedulers.where(F.col("status") == "VISIBLE ONLINE").groupBy(*keys).agg(F.count(F.lit(1)).alias("cpus"))
    ms = F.timestamp_diff("MILLISECOND", "prev_collected_at", "collected_at")
    used = F.col("cpu_time") - F.col("prev_cpu_time")
    return per.join(cpus, keys).select(*keys, "collected_at", "cpus", F.when(used >= 0, used).alias("cpu_ms"),
                                       F.when(used >= 0, ratio(used, F.col("cpus") * ms, 2, 100)).alias("cpu_percent"))


# ---- counters ---------------------------------------------------------------

#: Counters that describe memory (fixed values).
MANAGER_COUNTERS = (
    "Granted Workspace Memory (KB)", "Maximum Workspace Memory (KB)", "Memory Grants Outstanding", "Memory Grants Pending",
    "Target Server Memory (KB)", "Total Server Memory (KB)", "Connection Memory (KB)", "Lock Memory (KB)", "Optimizer Memory (KB)",
    "SQL Cache Memory (KB)", "Free Memory (KB)", "Reserved Server Memory (KB)", "Database Cache Memory (KB)", "Stolen Server Memory (KB)",
)
OBJECTS = ("Memory Manager", "Buffer Manager", "Plan Cache", "Buffer Node", "Memory Node", "Cursor")
OLD_NAMES = {"Free": "Free Memory", "Database": "Database Cache Memory", "Stolen": "Stolen Server Memory", "Reserved": "Reserved Server Memory", "Foreign": "Foreign Node Memory"}


def normalise_counters(counters: DataFrame) -> DataFrame:
    """Memory counters with plain object names, values in megabytes and the current names.

    Old counters that exist under their current name as well are dropped.
    """
    keys = fleet_keys(counters)
    obj = reduce(lambda acc, o: F.when(F.contains("object_name", F.lit(o)), F.lit(o)).otherwise(acc), reversed(OBJECTS), F.lit(None).cast("string"))
    name = F.rtrim("counter_name")
    rows = counters.select(*keys, obj.alias("object_name"), name.alias("_name"), F.rtrim("instance_name").alias("instance_name"), "cntr_value")
    paged = F.col("object_name").isin("Buffer Node", "Buffer Manager", "Memory Node", "Plan Cache")
    wanted = F.contains("_name", F.lit("pages ")) | F.endswith("_name", F.lit("pages")) | F.contains("_name", F.lit("Node Memory (KB)")) | (F.col("_name") == "Page life expectancy")
    rows = rows.where((paged & wanted) | ((F.col("object_name") == "Memory Manager") & F.col("_name").isin(*MANAGER_COUNTERS))
                      | ((F.col("object_name") == "Cursor") & (F.col("_name") == "Cursor memory usage") & (F.col("instance_name") == "_Total")))
    rows = rows.withColumn("_name", F.when(F.col("_name") == "Cursor memory usage", "Cursor memory usage (KB)").otherwise(F.col("_name")))
    mb = (F.when(F.lower("_name").endswith("pages"), ratio("cntr_value", F.lit(128), 2))
          .when(F.col("_name").endswith("(KB)"), ratio("cntr_value", F.lit(1024), 2)).otherwise(F.col("cntr_value").cast("double")))
    short = F.substring_index("_name", " ", 1)
    clean = F.regexp_replace("_name", r" pages| \(KB\)| \(MB\)", "")
    rows = rows.select(*keys, "object_name", clean.alias("counter_name"), "instance_name", "cntr_value", mb.alias("formatted_value"), short.alias("short_name"))
    current = rows.select(*keys, F.col("object_name").alias("_object"), "short_name").distinct()
    rows = rows.withColumn("_object", F.when(F.col("object_name").isin("Buffer Manager", "Buffer Node"), F.replace("object_name", F.lit("Buffer"), F.lit("Memory"))))
    kept = rows.where(F.col("_object").isNull()).unionByName(rows.where(F.col("_object").isNotNull()).join(current, [*keys, "_object", "short_name"], "left_anti"))
    taken = kept.where(F.col("object_name") == "Memory Manager").select(*keys, F.col("counter_name").alias("_new")).distinct().withColumn("_taken", F.lit(True))
    renamed = F.when(F.col("_object").isNotNull(), reduce(lambda acc, kv: F.when(F.col("counter_name") == kv[0], kv[1]).otherwise(acc), OLD_NAMES.items(), F.lit(None).cast("string")))
    out = kept.withColumn("_new", renamed).join(taken, [*keys, "_new"], "left")
    new = F.when(F.col("_new").isNotNull() & F.col("_taken").isNull(), F.col("_new")).otherwise(F.col("counter_name"))
    return out.select(*keys, F.coalesce("_object", "object_name").alias("object_name"), new.alias("counter_name"), "instance_name", "cntr_value", "formatted_value", "short_name")


def page_life_check(normalised: DataFrame) -> DataFrame:
    """Page life expectancy against its recommended minimum of 300 seconds per 4 GB
    of cache, and the memory grants. Nodes are listed where there are several."""
    keys = fleet_keys(normalised)
    cache = (normalised.where(F.col("counter_name") == "Database Cache Memory").groupBy(*keys, "instance_name")
             .agg((F.ceil(F.max("formatted_value") * 5 / 4096) * 60).cast("bigint").alias("_need")))
    node = F.col("object_name") == "Memory Node"
    nodes = normalised.where(node).groupBy(*keys, "instance_name").agg(F.lit(1).alias("x")).groupBy(*keys).agg(F.count(F.lit(1)).alias("_nodes"))
    manager = normalised.where((F.col("object_name") == "Memory Manager") & F.col("counter_name").isin("Memory Grants Outstanding", "Memory Grants Pending", "Page life expectancy"))
    life = normalised.where(node & (F.col("counter_name") == "Page life expectancy"))
    several = (life.join(nodes, keys) if keys else life.withColumn("_nodes", nodes.scalar())).where(F.col("_nodes") > 1).drop("_nodes")
    out = manager.unionByName(several).join(cache, [*keys, "instance_name"], "left")
    label = F.concat("counter_name", F.coalesce(F.concat(F.lit(" (Node: "), F.nullif("instance_name", F.lit("")), F.lit(")")), F.lit("")))
    return out.select(*keys, label.alias("counter"), F.col("cntr_value").alias("value"),
                      F.when(F.col("counter_name") == "Page life expectancy", F.greatest(F.lit(300).cast("bigint"), F.col("_need"))).alias("recommended_minimum"))


#: (object pattern, counter patterns) of the daily report.
DAILY_COUNTERS = (
    ("%buffer manager%", ("%page life%", "%buffer cache hit ratio%", "page reads/sec", "page writes/sec", "lazy writes/sec", "memory grants outstanding")),
    ("%memory manager%", ("%memory grants pending%", "%target server memory%", "%total server memory%")),
)


def counter_filter(counters: DataFrame, rules: Sequence[tuple[str, Sequence[str]]] = DAILY_COUNTERS) -> DataFrame:
    """Counters that match any (object pattern, counter patterns) pair, case does not count."""
    def one(obj: str, names: Sequence[str]) -> Column:
        return F.lower("object_name").like(obj) & reduce(lambda a, b: a | b, [F.lower("counter_name").like(n) for n in names])

    return counters.where(reduce(lambda a, b: a | b, [one(o, n) for o, n in rules]))


NODE_COUNTERS = ("Foreign Node Memory (KB)", "Stolen Node Memory (KB)", "Free Node Memory (KB)", "Database Node Memory (KB)", "Total Node Memory (KB)", "Target Node Memory (KB)")


def counter_pivot(counters: DataFrame, names: Sequence[str] = NODE_COUNTERS, free: str | None = None, total: str | None = None) -> DataFrame:
    """One column per counter, summed over instances, and the free share."""
    keys = fleet_keys(counters)
    name = F.rtrim("counter_name")
    out = counters.where((F.col("cntr_value") > 0) & name.isin(*names)).groupBy(*keys).agg(
        *[F.sum(F.when(name == n, F.col("cntr_value"))).alias(n) for n in names])
    if free and total:
        out = out.withColumn("percent_free", ratio(F.col(f"`{free}`"), F.col(f"`{total}`"), 2, 100))
    return out


def memory_summary(counters: DataFrame) -> DataFrame:
    """Target against total memory in words, page life expectancy and churn (MB per second)."""
    keys = fleet_keys(counters)

    def best(name: str) -> Column:
        return F.max(F.when(F.rtrim("counter_name") == name, F.col("cntr_value")))

    per = counters.groupBy(*keys).agg(best("Target Server Memory (KB)").alias("_target"), best("Total Server Memory (KB)").alias("_total"), best("Page life expectancy").alias("ple_s"))
    return per.select(*keys, ratio("_target", F.lit(1048576), 3).alias("target_gb"), ratio("_total", F.lit(1048576), 3).alias("total_gb"), "ple_s",
                      ratio("_total", F.col("ple_s") * 1024, 2).alias("churn_mb_s"),
                      F.when(F.col("_total") < F.col("_target"), "below target: memory is still being taken, or there is no more to take")
                      .otherwise("target reached").alias("target_vs_total"))


def memory_nodes(normalised: DataFrame) -> DataFrame:
    """The memory tree as rows (id, parent_id, name, amount) from normalised counters;
    what a stolen-memory node holds beyond its children becomes an `other` row."""
    keys = fleet_keys(normalised)
    mgr, name = F.col("object_name") == "Memory Manager", F.col("counter_name")

    def part(where: Column, node_id: Column | int, parent: Column | int | None, label: Column = name) -> DataFrame:
        as_id = (lambda x: x if isinstance(x, Column) else F.lit(x))
        return normalised.where(where).select(*keys, as_id(node_id).cast("bigint").alias("id"), as_id(parent).cast("bigint").alias("parent_id"),
                                              label.alias("name"), F.col("formatted_value").alias("amount"))

    plan = (F.col("object_name") == "Plan Cache") & (name == "Cache")
    whole = F.col("instance_name") == "_Total"
    parts = [
        part(mgr & (name == "Target Server Memory"), 1000, None),
        part(mgr & (name == "Maximum Workspace Memory"), 1100, 1000),
        part(mgr & (name == "Total Server Memory"), 1200, 1000),
        part(mgr & (name == "Granted Workspace Memory"), 1110, 1100),
        part(mgr & name.isin("Database Cache Memory", "Free Memory"), 1210, 1200),
        part(mgr & (name == "Stolen Server Memory"), 1220, 1200),
        part(mgr & (F.col("short_name") == "Reserved"), 1112, 1110),
        part((F.col("object_name") == "Cursor") | (mgr & F.col("short_name").isin("Connection", "Lock", "Optimizer", "SQL")), 1222, 1220),
        part(plan & whole, 1225, 1220, F.concat(F.lit("Plan "), name)),
        part(plan & ~whole, 1226, 1225, F.col("instance_name")),
    ]
    tree = reduce(DataFrame.unionByName, parts)
    children = tree.where(F.col("parent_id") == 1220).groupBy(*keys).agg(F.sum("amount").alias("_sum"))
    stolen = tree.where(F.col("id") == 1220).select(*keys, "amount")
    joined = stolen.join(children, keys) if keys else stolen.withColumn("_sum", children.scalar())
    other = joined.where(F.col("_sum").isNotNull()).select(*keys, F.lit(1222).cast("bigint").alias("id"), F.lit(1220).cast("bigint").alias("parent_id"), F.lit("<Other Memory Clerks>").alias("name"),
                                                           (F.col("amount") - F.col("_sum")).alias("amount"))
    return tree.unionByName(other)


def memory_tree(nodes: DataFrame, scale: int = 1) -> DataFrame:
    """The tree, all levels of it, with the share of the parent and, from the third
    level down, of the root. Shares are rounded to 4 decimals. A join a level; a row that no root reaches is left out."""
    keys = fleet_keys(nodes)
    amount = F.round(F.col("amount") * scale).cast("bigint") if dict(nodes.dtypes)["amount"] == "double" else F.col("amount")
    base = cut(nodes.withColumn("_a", amount))
    level = base.where(F.col("parent_id").isNull()).select(
        *keys, "id", "parent_id", "name", "amount", F.lit(0).alias("level"), F.col("name").alias("label"), F.lit(None).cast("double").alias("share_of_parent"),
        F.lit(None).cast("double").alias("share_of_root"), F.col("_a"), F.col("_a").alias("_root"))
    out, depth = level, 0
    while not level.isEmpty():
        depth += 1
        above = level.select(*keys, F.col("id").alias("parent_id"), F.col("_a").alias("_up"), "_root").distinct()
        level = cut(join_grown(base.where(F.col("parent_id").isNotNull()), above, [*keys, "parent_id"]).select(
            *keys, "id", "parent_id", "name", "amount", F.lit(depth).alias("level"),
            F.concat(F.lit(" " * 6 * (depth - 1) + "|···"), F.col("name")).alias("label"), F.coalesce(ratio("_a", "_up", 4), F.lit(0.0)).alias("share_of_parent"),
            F.when(F.lit(depth) >= 2, F.coalesce(ratio("_a", "_root", 4), F.lit(0.0))).alias("share_of_root"), "_a", "_root"))
        out = out.unionByName(level)
    return out.drop("_a", "_root")


def memory_clerks_top(clerks: DataFrame, n: int = 10) -> DataFrame:
    """The memory clerks that hold most."""
    keys = fleet_keys(clerks)
    per = clerks.groupBy(*keys, "clerk_type").agg(F.sum("pages_kb").alias("_kb"))
    return top_n(per, keys, ["-_kb", "clerk_type"], n).select(*keys, "clerk_type", ratio("_kb", F.lit(1024), 2).alias("memory_mb"))


def buffer_share_by_database(buffers: DataFrame) -> DataFrame:
    """Cached pages and megabytes per database, rank, share, free megabytes."""
    keys = fleet_keys(buffers)
    timed = "read_microsec" in buffers.columns
    per = reuse(buffers.groupBy(*keys, "database_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.sum("free_space_in_bytes").alias("_free"), *([F.avg("read_microsec").alias("avg_read_microsec")] if timed else [])))
    ranked = add_rank(per, keys, ["-page_count", "database_id"], "buffer_rank")
    ranked = with_totals(ranked, keys, {"_all": wide_sum("page_count")}, per)
    return ranked.select(*keys, "buffer_rank", "database_id", "page_count", ratio(F.col("page_count") * 8, F.lit(1024), 2).alias("cached_mb"),
                         ratio("page_count", "_all", 2, 100).alias("cached_pct"), int_div("_free", F.lit(1048576)).alias("free_mb"),
                         *(["avg_read_microsec"] if timed else []))


def buffer_by_object(buffers: DataFrame, allocation_units: DataFrame, partitions: DataFrame, objects: DataFrame, files: DataFrame, filegroups: DataFrame,
                     database_id: int | None = None) -> DataFrame:
    """Cached pages per object, index, filegroup and compression. Pages are counted
    per allocation unit and file before any join."""
    keys = fleet_keys(buffers, allocation_units, partitions, objects, files, filegroups)
    rows = buffers if database_id is None else buffers.where(F.col("database_id") == database_id)
    per = rows.groupBy(*keys, "allocation_unit_id", "file_id").agg(F.count(F.lit(1)).alias("_pages"))
    out = (per.join(allocation_units.select(*keys, "allocation_unit_id", F.col("container_id").alias("hobt_id")), [*keys, "allocation_unit_id"])
           .join(partitions.select(*keys, "hobt_id", "object_id", "index_id", "data_compression_desc"), [*keys, "hobt_id"])
           .join(objects.select(*keys, "object_id", F.col("name").alias("object_name")), [*keys, "object_id"])
           .join(files.select(*keys, "file_id", "data_space_id"), [*keys, "file_id"])
           .join(filegroups.select(*keys, "data_space_id", F.col("name").alias("filegroup_name")), [*keys, "data_space_id"]))
    out = out.groupBy(*keys, "filegroup_name", "object_id", "object_name", "index_id", "data_compression_desc").agg(F.sum("_pages").alias("buffer_count"))
    return out.withColumn("buffer_mb", ratio("buffer_count", F.lit(128), 2))


def os_memory(sys_memory: DataFrame, process_memory: DataFrame) -> DataFrame:
    """Memory of the host and of the server process in megabytes, share in use and low-memory alerts."""
    keys = fleet_keys(sys_memory, process_memory)

    def mb(col: str) -> Column:
        return int_div(col, F.lit(1024))

    low_p, low_v = F.col("process_physical_memory_low"), F.col("process_virtual_memory_low")
    alert = F.when(low_p & low_v, "Physical and Virtual").when(low_p, "Physical").when(low_v, "Virtual")
    return sys_memory.join(process_memory, keys).select(
        *keys, mb("total_physical_memory_kb").alias("physical_mb"), mb("available_physical_memory_kb").alias("available_mb"),
        mb("total_page_file_kb").alias("page_file_mb"), (mb("total_page_file_kb") - mb("total_physical_memory_kb")).alias("physical_page_file_mb"),
        mb("physical_memory_in_use_kb").alias("process_mb"), ratio(F.col("total_physical_memory_kb") - F.col("available_physical_memory_kb"), "total_physical_memory_kb", 2, 100).alias("used_pct"),
        "system_memory_state_desc", F.concat(alert, F.lit(" memory low!")).alias("low_memory_alert"))


# ---- topology and advice ----------------------------------------------------


def _visible(schedulers: DataFrame) -> DataFrame:
    return schedulers.where(F.startswith("status", F.lit("VISIBLE")) & (F.col("parent_node_id") < 64))


def numa_balance(schedulers: DataFrame) -> DataFrame:
    """Cores and online cores per memory node, whether they are equal, and the
    processor ranges that would spread the online cores evenly."""
    keys = fleet_keys(schedulers)
    per_node = _visible(schedulers).groupBy(*keys, "parent_node_id").agg(
        F.count(F.lit(1)).alias("cores"), F.sum(F.col("is_online").cast("int")).alias("online"), F.min("cpu_id").alias("first_cpu"))
    per = per_node.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("numa_nodes"), F.sum("cores").alias("total_cores"), F.sum("online").alias("online_cores"),
        (F.min("online") == F.max("online")).alias("balanced"), F.array_sort(F.collect_list(F.struct("parent_node_id", "first_cpu"))).alias("_nodes"))
    per = per.withColumn("cores_per_node", int_div("online_cores", "numa_nodes"))
    span = F.transform("_nodes", lambda x: F.concat(x.first_cpu.cast("string"), F.lit(" TO "), (x.first_cpu + F.col("cores_per_node") - 1).cast("string")))
    return per.withColumn("affinity", F.when(F.col("total_cores") == F.col("online_cores"), "AUTO").otherwise(F.array_join(span, ", "))).drop("_nodes")


def numa_nodes(nodes: DataFrame, memory_nodes_: DataFrame) -> DataFrame:
    """Node facts next to the memory of the node."""
    keys = [*fleet_keys(nodes, memory_nodes_), "memory_node_id"]
    mem = memory_nodes_.select(*keys, int_div("pages_kb", F.lit(1024)).alias("committed_mb"), int_div("target_kb", F.lit(1024)).alias("target_mb"), ratio("foreign_committed_kb", F.lit(1024), 2).alias("foreign_mb"))
    return nodes.where(F.col("node_state_desc") != "ONLINE DAC").join(mem, keys)


def scheduler_load(schedulers: DataFrame, task_limit: int = 10, io_limit: int = 1) -> DataFrame:
    """Average task, queue, runnable and pending I/O counts over the user schedulers (whole numbers), with flags above 10 tasks and 1."""
    keys = fleet_keys(schedulers)
    names = {"avg_tasks": "current_tasks_count", "avg_work_queue": "work_queue_count", "avg_runnable": "runnable_tasks_count", "avg_pending_io": "pending_disk_io_count"}
    per = schedulers.where(F.col("scheduler_id") < 255).groupBy(*keys).agg(*[int_div(F.sum(src), F.count(F.lit(1))).alias(new) for new, src in names.items()])
    return per.withColumns({"many_tasks": F.col("avg_tasks") > task_limit, "cpu_pressure": F.col("avg_runnable") > io_limit, "io_pressure": F.col("avg_pending_io") > io_limit})


def maxdop_advice(schedulers: DataFrame, sys_info: DataFrame, config: DataFrame) -> DataFrame:
    """Recommended parallelism by three published rule sets, per instance.

    `threshold_*`: at most the cores of a node, 8 for one node and 16 for several.
    `kin_maxdop`: from core count, hyper-threading and nodes.
    `check_*`: deviation of the current setting, with a cap of 8.
    """
    keys = fleet_keys(schedulers, sys_info, config)
    node = schedulers.where((F.col("parent_node_id") < 64) & (F.col("scheduler_id") <= 1048575)).groupBy(*keys, "parent_node_id").agg(
        F.count(F.lit(1)).alias("cpus"), F.sum(F.col("is_online").cast("int")).alias("online"))
    facts = node.groupBy(*keys).agg(F.count(F.lit(1)).alias("numa_nodes"), F.sum("cpus").alias("cpu_count"), F.sum("online").alias("online_count"), F.max("online").alias("per_node"))
    setting = config.where(F.lower("name") == "max degree of parallelism").select(*keys, F.col("value").alias("current_maxdop"))
    f = facts.join(setting, keys).join(sys_info.select(*keys, "hyperthread_ratio"), keys)
    n, cpus, online, per_node, cur = (F.col(x) for x in ("numa_nodes", "cpu_count", "online_count", "per_node", "current_maxdop"))
    effective = F.when(cur == 0, online).otherwise(cur)
    limit = F.when(n == 1, 8).otherwise(16)
    half = int_div(per_node, F.lit(2))
    threshold = (F.when(effective == 1, F.when(per_node <= limit, per_node).when(half <= limit, half).otherwise(limit))
                 .when((per_node <= limit) & (effective > per_node), per_node).when(per_node > limit, F.when(n == 1, 8).otherwise(16)))
    message = (F.when(effective == 1, "1 rules out parallel plans")
               .when((per_node <= limit) & (effective > per_node), "more than a node has processors")
               .when((per_node > limit) & (n == 1), "one large node: 8 is enough").when(per_node > limit, "more than 16"))
    ht, physical = cpus > F.col("hyperthread_ratio"), int_div(cpus, "hyperthread_ratio")
    kin = F.when((cpus < 8) & ~ht, cpus).when((cpus >= 8) & ~ht, F.lit(8)).when(cpus >= 8, int_div(per_node, physical))
    share = int_div(cpus, n)
    too_big, one_node = cur > online, (n == 1) & (online > 8) & ((cur == 0) | (cur > 8))
    small_nodes = (n > 1) & (share < 8) & ((cur == 0) | (cur > share))
    large_nodes = (n > 1) & (share >= 8) & ((cur == 0) | (cur > 8) | (cur > share))
    return f.select(
        *keys, "numa_nodes", "cpu_count", "online_count", "per_node", "current_maxdop", threshold.cast("bigint").alias("threshold_maxdop"), message.alias("threshold_message"), kin.cast("bigint").alias("kin_maxdop"),
        F.when(too_big, online).when(one_node, 8).when(small_nodes, share).when(large_nodes, 8).cast("bigint").alias("check_maxdop"),
        F.when(too_big, "more than the processors in use").when(one_node, "not the advised value for so many processors")
        .when(small_nodes | large_nodes, "not the advised value for so many processors a node").alias("check_deviation"))


#: Upper bound of host memory (MB) and what to leave to the host.
OS_RESERVE = ((2048, 512), (4096, 819), (8192, 1228), (12288, 2048), (24576, 2560), (32768, 3072))


def max_memory_advice(sys_memory: DataFrame, sys_info: DataFrame, config: DataFrame, schedulers: DataFrame) -> DataFrame:
    """Recommended memory limit: what the host has, less its reserve and the thread
    stacks; an alert where the setting exceeds the host or the recommendation."""
    keys = fleet_keys(sys_memory, sys_info, config, schedulers)
    sch = schedulers.where((F.col("scheduler_id") < 255) & (F.col("parent_node_id") < 64)).groupBy(*keys, "parent_node_id").agg(F.max(F.col("is_online").cast("int")).alias("on"))
    nodes = sch.groupBy(*keys).agg(F.count(F.lit(1)).alias("numa_nodes"), F.sum("on").alias("numa_nodes_affined"))
    setting = config.where(F.lower("name") == "max server memory (mb)").select(*keys, F.col("value").alias("max_memory_mb"))
    f = (sys_memory.select(*keys, int_div("total_physical_memory_kb", F.lit(1024)).alias("system_mb")).join(sys_info.select(*keys, "max_workers_count"), keys)
         .join(setting, keys).join(nodes, keys))
    system = F.col("system_mb")
    reserve = reduce(lambda acc, step: F.when(system <= step[0], step[1]).otherwise(acc), reversed(OS_RESERVE), F.lit(4096)).cast("bigint")
    f = f.withColumn("os_reserve_mb", reserve).withColumn("recommended_mb", system - reserve - (F.col("max_workers_count") * 2 - 256))
    cur, n = F.col("max_memory_mb"), F.col("numa_nodes")
    per_host, per_cur = int_div(system, n) * F.col("numa_nodes_affined"), int_div(cur, n) * F.col("numa_nodes_affined")
    best = F.when(n > 1, int_div("recommended_mb", n) * F.col("numa_nodes_affined")).otherwise(F.col("recommended_mb"))
    alert = (F.when(cur > system, "limit above what the host has")
             .when((n > 1) & (per_cur > per_host), "limit takes memory of other nodes")
             .when((n <= 1) & cur.between(F.col("recommended_mb"), system), "limit leaves the host too little"))
    return f.select(*f.columns, best.alias("recommended_for_nodes_mb"), alert.alias("alert"))


def resource_usage(resource_stats: DataFrame, as_of: Column | str, days: int = 15,
                   measures: Sequence[str] = ("avg_cpu_percent", "avg_data_io_percent", "avg_log_write_percent", "avg_memory_usage_percent")) -> DataFrame:
    """Average and maximum of the resource percentages over the last days."""
    keys = fleet_keys(resource_stats)
    recent = resource_stats.where(F.col("end_time") >= as_time(as_of) - F.make_interval(days=F.lit(days)))
    aggs = []
    for m in measures:
        hundredths = F.round(F.col(m) * 100).cast("bigint")
        aggs += [ratio(F.sum(wide(hundredths)), F.count(m) * 100, 2).alias(m), F.max(m).alias(m.replace("avg_", "max_"))]
    return recent.groupBy(*keys).agg(*aggs)


def resource_io_share(resource_stats: DataFrame) -> DataFrame:
    """Megabytes read and written per sample and their shares."""
    both = F.col("io_bytes_read") + F.col("io_bytes_written")
    rows = resource_stats.where((F.col("io_bytes_read") > 0) & (F.col("io_bytes_written") > 0))
    return rows.select(*fleet_keys(resource_stats), "end_time", ratio("io_bytes_read", F.lit(1048576), 2).alias("mb_read"), ratio("io_bytes_read", both, 2, 100).alias("read_pct"),
                       ratio("io_bytes_written", F.lit(1048576), 2).alias("mb_written"), ratio("io_bytes_written", both, 2, 100).alias("write_pct"), ratio(both, F.lit(1048576), 2).alias("mb_total"))


def resource_pools(pools: DataFrame) -> DataFrame:
    """Resource pools with their memory in megabytes."""
    kb = [x for x in pools.columns if x.endswith("_kb")]
    return pools.select(*[x for x in pools.columns if x not in kb], *[int_div(x, F.lit(1024)).alias(x[:-3] + "_mb") for x in kb])


def cpu_topology_inventory(sys_info: DataFrame, as_of: Column | str) -> DataFrame:
    """Physical cores and hours since the start of the server."""
    return sys_info.select("*", (F.col("socket_count") * F.col("cores_per_socket")).alias("physical_cores"),
                           minute_boundaries("start_time", as_time(as_of), "HOUR").alias("uptime_hours"))
