"""Backups, restores and log shipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import as_time, coded, fleet_keys, int_div, minute_boundaries, ratio, seconds_between
from fleetlens.plans.ordering import first_per, top_n
from fleetlens.plans.sequences import with_previous

BACKUP_TYPES = {"D": "Database", "I": "Differential database", "L": "Log"}
RESTORE_TYPES = {"D": "Database", "F": "File", "I": "Differential", "L": "Log"}
AGENTS = {1: "Backup", 2: "Copy", 3: "Restore"}


def last_backups(databases: DataFrame, backupset: DataFrame, as_of: Column | str, days: int = 30, on: str = "database_id") -> DataFrame:
    """The last full, differential and log backup of every database within `days`, NULL where there is none."""
    keys = [*fleet_keys(databases, backupset), on]
    recent = backupset.where(F.col("backup_finish_date") > as_time(as_of) - F.make_interval(days=F.lit(days)))
    names = {"D": "last_full", "I": "last_differential", "L": "last_log"}
    per = recent.groupBy(*keys).agg(*[F.max(F.when(F.col("type") == k, F.col("backup_finish_date"))).alias(v) for k, v in names.items()])
    return databases.where(F.col("name") != "tempdb").join(per, keys, "left")


def stale_backups(databases: DataFrame, backupset: DataFrame, as_of: Column | str, hours: int = 24, backup_type: str = "L", on: str = "database_id") -> DataFrame:
    """Databases whose last backup of a type is too old, with its age in hours, and those never backed up (9999)."""
    keys = [*fleet_keys(databases, backupset), on]
    now = as_time(as_of)
    last = backupset.where(F.col("type") == backup_type).groupBy(*keys).agg(F.max("backup_finish_date").alias("last_backup"))
    old = last.where(F.col("last_backup") < now - F.make_interval(hours=F.lit(hours))).withColumn("age_hours", minute_boundaries("last_backup", now, "HOUR"))
    never = databases.where(F.col("name") != "tempdb").join(backupset.select(*keys), keys, "left_anti").select(
        *keys, F.lit(None).cast("timestamp_ntz").alias("last_backup"), F.lit(9999).cast("bigint").alias("age_hours"))
    return old.unionByName(never)


def backup_history(backupset: DataFrame, media: DataFrame, since: Column | str | None = None, types: Sequence[str] = ("D", "I", "L")) -> DataFrame:
    """Backups with type in words, size in GB and device."""
    keys = [*fleet_keys(backupset, media), "media_set_id"]
    rows = backupset.where(F.col("type").isin(*types))
    if since is not None:
        rows = rows.where(F.col("backup_start_date") >= as_time(since))
    return rows.join(media.select(*keys, "physical_device_name"), keys).select(
        *backupset.columns, coded("type", BACKUP_TYPES).alias("backup_type"), ratio("backup_size", F.lit(1 << 30), 2).alias("backup_gb"), "physical_device_name")


def recent_full_backups(backupset: DataFrame, media: DataFrame, n: int = 30, backup_type: str = "D") -> DataFrame:
    """The newest backups of a type with their compression ratio and duration."""
    scope = fleet_keys(backupset, media)
    rows = backupset.where(F.col("type") == backup_type).join(media.select(*scope, "media_set_id", "physical_device_name"), [*scope, "media_set_id"])
    best = top_n(rows, scope, ["-backup_finish_date", "backup_set_id", "physical_device_name"], n)
    return best.select(*scope, "backup_set_id", "database_id", "backup_finish_date", int_div("backup_size", F.lit(1048576)).alias("backup_mb"),
                       int_div("compressed_backup_size", F.lit(1048576)).alias("compressed_mb"), ratio("backup_size", "compressed_backup_size", 2).alias("compression_ratio"),
                       seconds_between("backup_start_date", "backup_finish_date").alias("elapsed_s"), "physical_device_name")


def lsn_chain(backupset: DataFrame, on: str = "database_id", gaps_only: bool = False) -> DataFrame:
    """Log backups of each database in order; a gap is where one does not begin at the last sequence number of the one before."""
    keys = [*fleet_keys(backupset), on]
    logs = backupset.where(F.col("type") == "L")
    out = with_previous(logs, keys, ["backup_finish_date", "backup_set_id"], ["last_lsn"], F.date_trunc("MONTH", F.col("backup_finish_date")))
    out = out.withColumn("is_gap", F.coalesce(F.col("first_lsn") != F.col("prev_last_lsn"), F.lit(False)))
    return out.where("is_gap") if gaps_only else out


def restore_history(restorehistory: DataFrame, backupset: DataFrame, media: DataFrame, files: DataFrame) -> DataFrame:
    """Restores with their source file, type in words, target file and user."""
    keys = fleet_keys(restorehistory, backupset, media, files)
    return (restorehistory.join(backupset.select(*keys, "backup_set_id", "media_set_id", "backup_start_date", "backup_finish_date"), [*keys, "backup_set_id"])
            .join(media.select(*keys, "media_set_id", "physical_device_name"), [*keys, "media_set_id"])
            .join(files.select(*keys, "restore_history_id", "destination_phys_name"), [*keys, "restore_history_id"])
            .withColumn("restore_type_text", F.coalesce(coded("restore_type", RESTORE_TYPES), F.col("restore_type"))))


def rpo_status(restorehistory: DataFrame, backupset: DataFrame, media: DataFrame, as_of: Column | str, low: int = 15, medium: int = 60, high: int = 240) -> DataFrame:
    """The last restored backup per database and how far behind it leaves the copy."""
    keys = fleet_keys(restorehistory, backupset, media)
    last = first_per(restorehistory.select(*keys, "database_id", "restore_date", "restore_history_id", "backup_set_id"), [*keys, "database_id"], ["-restore_date", "-restore_history_id"])
    out = last.join(backupset.select(*keys, "backup_set_id", "media_set_id", "backup_start_date"), [*keys, "backup_set_id"]).join(
        media.select(*keys, "media_set_id", "physical_device_name"), [*keys, "media_set_id"])
    behind = minute_boundaries("backup_start_date", as_time(as_of))
    status = F.when(behind > high, "RPO High Warning!").when(behind > medium, "RPO Medium Warning!").when(behind > low, "RPO Low Warning!").otherwise("RPO Good")
    return out.select(*keys, "database_id", status.alias("status"), F.col("physical_device_name").alias("last_file"), F.col("backup_start_date").alias("created"), F.col("restore_date").alias("restored"), behind.alias("minutes_behind"))


def _device(path: str) -> Column:
    return F.upper(F.regexp_extract(path, r"^(..[^\\]*)\\", 1))


def backups_on_data_volume(media: DataFrame, backupset: DataFrame, files: DataFrame, as_of: Column | str, days: int = 10) -> DataFrame:
    """Devices that hold both recent backups and database files, with the number of each."""
    keys = fleet_keys(media, backupset, files)
    recent = backupset.where(F.col("backup_start_date") > as_time(as_of) - F.make_interval(days=F.lit(days)))
    paths = media.where(F.col("physical_device_name").isNotNull()).join(recent.select(*keys, "media_set_id"), [*keys, "media_set_id"], "left_semi")
    backups = paths.select(*keys, "physical_device_name", _device("physical_device_name").alias("device")).distinct().groupBy(*keys, "device").agg(F.count(F.lit(1)).alias("backup_files"))
    user = (F.col("database_id") > 3) | (F.col("database_id") == 2)
    data = files.where(user & (F.col("database_id") != 32767)).select(*keys, "physical_name", _device("physical_name").alias("device")).distinct().groupBy(*keys, "device").agg(F.count(F.lit(1)).alias("database_files"))
    return backups.join(data, [*keys, "device"])


def log_shipping_config(primaries: DataFrame, secondaries: DataFrame, monitor: DataFrame) -> DataFrame:
    """Primary databases with their secondaries and monitor thresholds."""
    keys = [*fleet_keys(primaries, secondaries, monitor), "primary_id"]
    return primaries.join(secondaries, keys).join(monitor, keys)


def log_shipping_alerts(monitor: DataFrame) -> DataFrame:
    """Databases whose backup or restore is later than allowed, or whose status is bad."""
    late_backup = F.col("is_backup_alert_enabled") & (F.col("time_since_last_backup") > F.col("backup_threshold"))
    late_restore = F.col("is_restore_alert_enabled") & (F.col("time_since_last_restore") > F.col("last_restored_latency"))
    text = (F.when(late_backup, F.concat(F.lit("log backup is late; last file: "), F.coalesce("last_backup_file", F.lit("(null)"))))
            .when(late_restore, F.concat(F.lit("log restore is late; last file: "), F.coalesce("last_restored_file", F.lit("(null)")))).otherwise("reported as unhealthy"))
    who = F.concat("database_name", F.when(F.col("is_primary"), " (Primary)").otherwise(" (Secondary)"))
    return monitor.where(F.col("status") | late_backup | late_restore).select(*fleet_keys(monitor), who.alias("object_name"), text.alias("details"))


def log_shipping_errors(errors: DataFrame) -> DataFrame:
    """Agent errors with the agent in words."""
    return errors.withColumn("agent", coded("agent_type", AGENTS))


def encryption_certificates(encryption_keys: DataFrame, certificates: DataFrame, databases: DataFrame) -> DataFrame:
    """Encrypted databases with the certificate of their key; keys without one are kept."""
    keys = fleet_keys(encryption_keys, certificates, databases)
    certs = certificates.select(*keys, F.col("thumbprint").alias("encryptor_thumbprint"), F.col("name").alias("certificate_name"))
    return (encryption_keys.join(databases.select(*keys, "database_id", F.col("name").alias("database_name")), [*keys, "database_id"])
            .join(certs, [*keys, "encryptor_thumbprint"], "left").select(*keys, "database_id", "database_name", "certificate_name"))
