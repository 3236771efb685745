"""Availability groups, replication and mirroring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_time, c, coded, fleet_keys, ratio, seconds_between
from fleetlens.plans.ordering import first_per


def failover_readiness(groups: DataFrame, replicas: DataFrame, replica_states: DataFrame, db_states: DataFrame, cluster_states: DataFrame) -> DataFrame:
    """Each database on each replica with a verdict for planned failover, next to
    the primary and the secondaries of its group (a group has at most a few replicas)."""
    keys = fleet_keys(groups, replicas, replica_states, db_states, cluster_states)
    members = replicas.join(replica_states.select(*keys, "replica_id", "role_desc", "connected_state_desc"), [*keys, "replica_id"])
    secondary = F.array_sort(F.collect_list(F.when(F.col("role_desc") == "SECONDARY", F.col("replica_name"))))
    info = members.groupBy(*keys, "group_id").agg(
        F.max(F.when(F.col("role_desc") == "PRIMARY", F.col("replica_name"))).alias("primary_replica"), F.array_join(secondary, ", ").alias("secondary_replicas"))
    out = (members.join(info, [*keys, "group_id"]).join(groups.select(*keys, "group_id", F.col("name").alias("group_name")), [*keys, "group_id"])
           .join(db_states, [*keys, "replica_id"]).join(cluster_states.select(*keys, "replica_id", "database_id", "is_failover_ready"), [*keys, "replica_id", "database_id"], "left"))
    online, synced = F.col("database_state_desc") == "ONLINE", F.col("synchronization_state_desc") == "SYNCHRONIZED"
    healthy, linked, held = F.col("synchronization_health_desc") == "HEALTHY", F.col("connected_state_desc") == "CONNECTED", F.col("is_suspended")
    verdict = (F.when(F.col("is_failover_ready") & synced & healthy & online & ~held & linked, "READY FOR PLANNED FAILOVER").when(held, "Database Suspended")
               .when(~linked, "Replica Disconnected").when(~online, "Database Offline").when(~synced, "Database Not Synchronized")
               .when(~healthy, "Synchronization Not Healthy").otherwise("Review Replica"))
    return out.select(*keys, "group_name", "primary_replica", "secondary_replicas", "replica_id", "replica_name", "role_desc", "connected_state_desc", "database_id",
                      "database_state_desc", "synchronization_state_desc", "synchronization_health_desc", "is_suspended", "is_failover_ready", verdict.alias("failover_status"))


def _queue_seconds(queue: str, rate: str) -> Column:
    return F.coalesce(F.when(F.col(rate) == 0, -1.0).otherwise(ratio(queue, rate, 2)), F.lit(-1.0))


def replica_lag(replicas: DataFrame, db_states: DataFrame, replica_states: DataFrame, cluster_states: DataFrame) -> DataFrame:
    """Estimated data loss and recovery seconds of each database replica: the commit
    lag behind the primary (0 when ready to fail over), and queue by rate (-1 without a rate)."""
    keys = fleet_keys(replicas, db_states, replica_states, cluster_states)
    roles = replica_states.select(*keys, "replica_id", "role_desc")
    primary = db_states.join(roles.where(F.col("role_desc") == "PRIMARY"), [*keys, "replica_id"], "left_semi").select(
        *keys, "database_id", F.col("last_commit_time").alias("_primary_commit"))
    out = (replicas.join(roles, [*keys, "replica_id"]).join(cluster_states.select(*keys, "replica_id", "database_id", "is_failover_ready"), [*keys, "replica_id"])
           .join(db_states, [*keys, "replica_id", "database_id"], "left").join(primary, [*keys, "database_id"], "left"))
    loss = F.when(F.col("is_failover_ready"), F.lit(0).cast("bigint")).otherwise(F.coalesce(seconds_between("last_commit_time", "_primary_commit"), F.lit(0).cast("bigint")))
    return out.select(*keys, "replica_id", "replica_name", "database_id", F.coalesce("is_failover_ready", F.lit(False)).alias("is_failover_ready"), "role_desc",
                      loss.alias("data_loss_s"), _queue_seconds("redo_queue_size", "redo_rate").alias("recovery_s"),
                      _queue_seconds("log_send_queue_size", "log_send_rate").alias("synchronization_s"), F.coalesce("is_suspended", F.lit(False)).alias("is_suspended"))


def commit_lag(states: DataFrame, reporting: Column, failover: Column) -> DataFrame:
    """Per database the last commit on the primary, the reporting and the failover
    copies, and how many seconds the copies are behind. `reporting` and `failover`
    are conditions that pick secondaries."""
    keys = [*fleet_keys(states), "database_id"]
    second = F.col("role_desc") == "SECONDARY"

    def commits(where: Column, name: str) -> DataFrame:
        return states.where(where).groupBy(*keys).agg(F.max("last_commit_time").alias(name))

    out = commits(F.col("role_desc") == "PRIMARY", "primary_commit").join(commits(second & reporting, "reporting_commit"), keys, "left").join(
        commits(second & failover, "failover_commit"), keys, "left")
    return out.withColumns({"reporting_lag_s": seconds_between("reporting_commit", "primary_commit"), "failover_lag_s": seconds_between("failover_commit", "primary_commit")})


def ag_inventory(groups: DataFrame, replicas: DataFrame, replica_states: DataFrame, db_states: DataFrame) -> DataFrame:
    """All database replicas of all groups with role and state."""
    keys = fleet_keys(groups, replicas, replica_states, db_states)
    return (db_states.join(replicas, [*keys, "replica_id"]).join(groups.select(*keys, "group_id", F.col("name").alias("group_name")), [*keys, "group_id"])
            .join(replica_states.select(*keys, "replica_id", "role_desc", "connected_state_desc"), [*keys, "replica_id"]))


def node_roles(replicas: DataFrame, replica_states: DataFrame) -> DataFrame:
    """Which node plays which role in which group, each once."""
    keys = fleet_keys(replicas, replica_states)
    return replicas.join(replica_states, [*keys, "replica_id"]).select(*keys, "group_id", "replica_name", "role_desc", "connected_state_desc").distinct()


#: Messages about availability groups (fixed values).
HA_MESSAGES = (976, 983, 1480, 19406, 35254, 35262, 35273, 35274, 35275, 35276, 35279, 35299, 41048, 41049, 41050, 41051, 41052, 41053, 41054, 41055, 41089, 41091, 41131, 41406, 41414, 41421)


def ha_message_catalog(messages: DataFrame, ids: tuple[int, ...] = HA_MESSAGES) -> DataFrame:
    """Text and severity of the messages that concern availability."""
    return messages.where(F.col("message_id").isin(*ids)).select(*fleet_keys(messages), "message_id", "text", "severity")


def endpoint_permissions(permissions: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Who may connect to which endpoint."""
    keys = fleet_keys(permissions, endpoints)
    ends = endpoints.select(*keys, F.col("endpoint_id").alias("major_id"), F.col("name").alias("endpoint_name"))
    return permissions.join(ends, [*keys, "major_id"])


# ---- replication ---------------------------------------------------------------

PUBLICATION_TYPES = {0: "Transactional", 1: "Snapshot", 2: "Merge"}
AGENT_STATUS = {1: "Start", 2: "Succeed", 3: "In progress", 4: "Idle", 5: "Retry", 6: "Fail"}


def _server_names(servers: DataFrame, other_servers: DataFrame, keys: list[str]) -> DataFrame:
    both = servers.select(*keys, "server_id", F.col("name").alias("_a")).join(other_servers.select(*keys, "server_id", F.col("name").alias("_b")), [*keys, "server_id"], "full")
    return both.select(*keys, "server_id", F.coalesce("_a", "_b").alias("server_name"))


def replication_topology(publications: DataFrame, articles: DataFrame, subscriptions: DataFrame, servers: DataFrame, other_servers: DataFrame, agents: DataFrame) -> DataFrame:
    """Flat rows publisher, publication, article, subscriber with the distribution agent.
    Server names come from either of two server tables; placeholder subscribers are left out."""
    keys = fleet_keys(publications, articles, subscriptions, servers, other_servers, agents)
    names = _server_names(servers, other_servers, keys)
    publisher = names.select(*keys, F.col("server_id").alias("publisher_id"), F.col("server_name").alias("publisher"))
    subscriber = names.select(*keys, F.col("server_id").alias("subscriber_id"), F.col("server_name").alias("subscriber")).where(~F.col("subscriber").isin("anonymous", "virtual", ""))
    subs = subscriptions.where(F.col("subscriber_db").isNotNull()).select(*keys, "publication_id", "subscriber_id", "subscriber_db").distinct()
    return (publications.join(articles.select(*keys, "publication_id", "article"), [*keys, "publication_id"]).join(subs, [*keys, "publication_id"])
            .join(publisher, [*keys, "publisher_id"], "left").join(subscriber, [*keys, "subscriber_id"])
            .join(agents.select(*keys, "publisher_id", "subscriber_id", F.col("name").alias("agent")).distinct(), [*keys, "publisher_id", "subscriber_id"], "left")
            .select(*keys, "publisher", "publication", "article", "subscriber", "subscriber_db", "agent").distinct())


def replication_tree(publications: DataFrame, articles: DataFrame, subscriptions: DataFrame, servers: DataFrame, other_servers: DataFrame) -> DataFrame:
    """The same as a tree: rows of level, path and text for publishers, publications
    (with type and number of articles) and subscribers. Sort by path to print it."""
    keys = fleet_keys(publications, articles, subscriptions, servers, other_servers)
    names = _server_names(servers, other_servers, keys)

    def named(prefix: str) -> DataFrame:
        return names.select(*keys, F.col("server_id").alias(f"{prefix}_id"), F.col("server_name").alias(prefix))

    pub = publications.join(named("publisher"), [*keys, "publisher_id"])
    count = articles.groupBy(*keys, "publication_id").agg(F.count(F.lit(1)).alias("_articles"))
    pub = pub.join(count, [*keys, "publication_id"], "left").withColumn("_articles", F.coalesce("_articles", F.lit(0)))
    top = pub.select(*keys, "publisher").distinct().select(*keys, F.lit(1).alias("level"), F.col("publisher").alias("path"), F.concat(F.lit("|- "), F.col("publisher"), F.lit(" (Publisher)")).alias("text"))
    two = pub.select(*keys, F.lit(2).alias("level"), F.concat_ws("/", "publisher", "publication").alias("path"), F.concat(
        F.lit(" |- "), F.col("publication"), F.lit(" (Publication type: "), coded("publication_type", PUBLICATION_TYPES, "Unknown"), F.lit("; "), F.col("_articles").cast("string"), F.lit(" article(s))")).alias("text"))
    subs = subscriptions.select(*keys, "publication_id", "subscriber_id", "subscriber_db").distinct().join(pub.select(*keys, "publication_id", "publisher", "publication"), [*keys, "publication_id"]).join(
        named("subscriber"), [*keys, "subscriber_id"])
    three = subs.select(*keys, F.lit(3).alias("level"), F.concat_ws("/", "publisher", "publication", "subscriber", "subscriber_db").alias("path"),
                        F.concat(F.lit("  |- "), F.col("subscriber"), F.lit("."), F.col("subscriber_db")).alias("text"))
    return reduce(DataFrame.unionByName, [top, two, three])


def replication_row_diff(articles: DataFrame, publisher_counts: DataFrame, subscriber_counts: DataFrame) -> DataFrame:
    """Rows of each article on both sides and the difference; a missing side gives an error text."""
    keys = [*fleet_keys(articles, publisher_counts, subscriber_counts), "article_id"]
    out = articles.join(publisher_counts.select(*keys, F.col("row_count").alias("publisher_rows")), keys, "left").join(
        subscriber_counts.select(*keys, F.col("row_count").alias("subscriber_rows")), keys, "left")
    error = F.concat_ws(" | ", F.when(F.col("publisher_rows").isNull(), "Publisher: no count"), F.when(F.col("subscriber_rows").isNull(), "Subscriber: no count"))
    return out.withColumns({"row_difference": F.col("publisher_rows") - F.col("subscriber_rows"), "count_error": F.nullif(error, F.lit(""))})


def tracer_latency(tokens: DataFrame, history: DataFrame, publications: DataFrame) -> DataFrame:
    """Seconds a tracer took to the distributor and on to the subscriber."""
    keys = fleet_keys(tokens, history, publications)
    return (tokens.join(history.select(*keys, "tracer_id", "agent_id", "subscriber_commit"), [*keys, "tracer_id"]).join(publications.select(*keys, "publication_id", "publication"), [*keys, "publication_id"])
            .select(*keys, "tracer_id", "publication_id", "publication", "agent_id", seconds_between("publisher_commit", "distributor_commit").alias("to_distributor_s"),
                    seconds_between("distributor_commit", "subscriber_commit").alias("to_subscriber_s")))


def agent_history(history: DataFrame, agents: DataFrame, errors: DataFrame) -> DataFrame:
    """History of replication agents with status and error in words."""
    keys = fleet_keys(history, agents, errors)
    return (history.join(agents.select(*keys, "agent_id", F.col("name").alias("agent_name")), [*keys, "agent_id"])
            .join(errors.select(*keys, "error_id", "error_text"), [*keys, "error_id"], "left").withColumn("status", coded("runstatus", AGENT_STATUS)))


def geo_replication(links: DataFrame, max_lag_s: int = 60) -> DataFrame:
    """Replication links with their lag and whether it is above the limit."""
    return links.select(*fleet_keys(links), "link_id", "partner_server", "partner_database", "last_replication", "replication_lag_sec", "replication_state_desc", "role_desc",
                        (F.col("replication_lag_sec") > max_lag_s).alias("is_late"))


MIRROR_ROLES = {1: "Principal", 2: "Mirror"}
MIRROR_STATES = {0: "Suspended", 1: "Disconnected", 3: "Pending Failover"}


def mirroring_alerts(monitor: DataFrame, max_delay_ms: int = 1000, max_unsent_kb: int = 1000, max_unrestored_kb: int = 1000) -> DataFrame:
    """The newest state of each mirrored database, where it is not healthy or above a threshold."""
    keys = [*fleet_keys(monitor), "database_id"]
    now = first_per(monitor, keys, ["-time", "-row_id"])
    bad, alone = ~F.col("status").isin(2, 4), F.col("witness_status") == 2
    over = {"Transaction Delay is ": ("transaction_delay", max_delay_ms), "Unsent Log is ": ("send_queue_size", max_unsent_kb), "Unrestored Log is ": ("redo_queue_size", max_unrestored_kb)}
    tests = [F.col(col) > limit for col, limit in over.values()]
    text = F.concat_ws(", ", *[F.when(F.col(col) > limit, F.concat(F.lit(label), F.col(col).cast("string"))) for label, (col, limit) in over.items()])
    details = F.when(bad, F.concat(F.lit("Mirroring State is "), F.coalesce(coded("status", MIRROR_STATES), F.col("status").cast("string")))).when(alone, "Witness Status is Disconnected").otherwise(text)
    return now.where(bad | alone | reduce(lambda a, b: a | b, tests)).select(*keys, F.coalesce(coded("role", MIRROR_ROLES), F.col("role").cast("string")).alias("role"), details.alias("details"))


REPAIR_ERRORS = {-1: "Hardware 823 Error", 1: "General 824 Error", 2: "Bad Checksum", 3: "Torn Page"}
REPAIR_STATUS = {2: "Queued for Request from Partner", 3: "Request Sent to Partner", 4: "Queued for Automatic Page Repair", 5: "Automatic Page Repair Succeeded", 6: "Unable to Repair"}


def page_repairs(repairs: DataFrame, files: DataFrame, as_of: Column | str, minutes: int = 360) -> DataFrame:
    """Automatic page repairs of the last minutes, codes in words."""
    keys = [*fleet_keys(repairs, files), "database_id", "file_id"]
    recent = repairs.where(F.col("modification_time") >= as_time(as_of) - F.make_interval(mins=F.lit(minutes)))

    def known(col: str, texts: dict) -> Column:
        return F.coalesce(coded(col, texts), F.concat(F.lit("Unknown - "), c(col).cast("string")))

    return recent.join(files.select(*keys, F.col("name").alias("file_name")), keys).select(
        *keys, "file_name", "page_id", known("error_type", REPAIR_ERRORS).alias("error"), known("page_status", REPAIR_STATUS).alias("status"), "modification_time")


def publication_failures(publications: DataFrame) -> DataFrame:
    """Publications whose status is failed."""
    return publications.where(F.col("status") == 6).withColumn("details", F.concat(F.lit("LogReader Agent: "), F.col("logreader_agent"), F.lit(",  Snapshot Agent: "), F.col("snapshot_agent")))


IGNORED_PRINCIPALS = ("BUILTIN\\Administrators", "NT AUTHORITY\\SYSTEM", "sa")


def principal_diff(primary: DataFrame, replica: DataFrame, on: tuple[str, ...] = ("name", "type")) -> DataFrame:
    """Principals (or, with other columns in `on`, role memberships) of the primary that the replica lacks."""
    keys = [*fleet_keys(primary, replica), *on]
    wanted = primary.where(~F.col(on[0]).cast("string").isin(*IGNORED_PRINCIPALS)).select(*keys).distinct()
    return wanted.join(replica.select(*keys), keys, "left_anti")
