"""Users, owners, permissions and linked servers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.columns import bracket, fleet_keys

#: Schemas that do not belong to a role of the same name (fixed values).
SHARED_SCHEMAS = ("managed_backup", "smart_admin", "MS_PerfDashboard")
#: Schemas of monitoring products that keep their own owner (fixed values).
SPARED_SCHEMAS = ("SQLSentry", "SentryOne")


def orphaned_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Database users whose login does not exist, with a hint where a login of the same name does."""
    keys = fleet_keys(users, logins)
    lost = users.where(F.col("authentication_type_desc") == "INSTANCE").join(logins.select(*keys, "sid"), [*keys, "sid"], "left_anti")
    named = logins.select(*keys, "name").distinct().withColumn("_same", F.lit(True))
    hint = F.when(F.col("_same"), "a login of that name exists").otherwise("no login of that name")
    return lost.join(named, [*keys, "name"], "left").withColumn("details", hint).drop("_same")


def invalid_owners(schemas: DataFrame, roles: DataFrame, databases: DataFrame, principals: DataFrame) -> DataFrame:
    """System schemas, roles and databases that the wrong principal owns, with the
    expected owner and the statement to fix it."""
    keys = [*fleet_keys(schemas, roles, databases, principals), "database_id"]
    owner = principals.select(*keys, F.col("principal_id").alias("owner_id"), F.col("name").alias("owner_name"))

    def owned(df: DataFrame) -> DataFrame:
        return df.join(owner, [*keys, "owner_id"], "left")

    shared = F.col("name").isin(*SHARED_SCHEMAS)
    s = owned(schemas.where((F.col("object_id") >= 16384) & ~F.col("name").isin(*SPARED_SCHEMAS))).where(
        F.col("owner_name").isNull() | (~shared & (F.col("name") != F.col("owner_name"))) | (shared & (F.col("owner_id") != 1)))
    r = owned(roles.where(F.col("object_id") >= 16384)).where(F.col("owner_name").isNull() | (F.col("owner_id") != 1))
    d = owned(databases.where(F.col("database_id") <= 4)).where(F.col("owner_name").isNull() | (F.col("owner_sid") != "0x01"))

    def shaped(df: DataFrame, kind: str, expected: Column) -> DataFrame:
        fix = F.concat(F.lit(f"ALTER AUTHORIZATION ON {kind}::"), bracket("name"), F.lit(" TO "), bracket(expected), F.lit(";"))
        return df.select(*keys, F.concat(F.lit(f"{kind}::"), bracket("name")).alias("object_name"), "owner_name", expected.alias("owner_should_be"), fix.alias("fix"))

    return reduce(DataFrame.unionByName, [shaped(s, "SCHEMA", F.col("name")), shaped(r, "ROLE", F.lit("dbo")), shaped(d, "DATABASE", F.lit("sa"))])


def permission_export(users: DataFrame, members: DataFrame, permissions: DataFrame, objects: DataFrame, columns: DataFrame, schemas: DataFrame, database: str = "db", drop: bool = False) -> DataFrame:
    """The users, role members and permissions of a database as ordered statements
    (`section` orders them). With `drop` the statements take them away instead.
    No password or password hash is read or written."""
    keys = fleet_keys(users, members, permissions, objects, columns, schemas)
    user = users.where(F.col("type").isin("G", "S", "U")).select(*keys, F.col("principal_id").alias("grantee_id"), F.col("name").alias("grantee"), "type")
    regular = user.where(F.col("grantee_id") > 4)
    verb = F.when(F.col("state") != "W", F.col("state_desc")).otherwise("GRANT")
    if drop:
        verb = F.lit("REVOKE")
    tail = F.lit("") if drop else F.when(F.col("state") != "W", "").otherwise(" WITH GRANT OPTION")
    to = F.concat(F.lit(" FROM " if drop else " TO "), bracket("grantee"))
    granted = permissions.select(*keys, "class", "major_id", "minor_id", "grantee_id", "permission_name", "state", "state_desc")

    def rows(df: DataFrame, section: int, text: Column) -> DataFrame:
        return df.select(*keys, F.lit(section).alias("section"), text.alias("statement"))

    head = rows(users.select(*keys).distinct() if keys else users.limit(1), 1, F.lit(f"USE [{database}]"))
    create = F.concat(F.lit("CREATE USER "), bracket("grantee"), F.lit(" FOR LOGIN "), bracket("grantee"), F.lit(";"))
    people = rows(user, 4, F.concat(F.lit("DROP USER "), bracket("grantee"), F.lit(";")) if drop else create)
    role_names = users.select(*keys, F.col("principal_id").alias("role_id"), F.col("name").alias("role_name"))
    joined = members.join(role_names, [*keys, "role_id"]).join(regular.select(*keys, F.col("grantee_id").alias("member_id"), "grantee"), [*keys, "member_id"])
    member = rows(joined, 6, F.concat(F.lit("ALTER ROLE "), bracket("role_name"), F.lit(" DROP MEMBER " if drop else " ADD MEMBER "), bracket("grantee"), F.lit(";")))
    on_object = (granted.where(F.col("class") == 1).join(user, [*keys, "grantee_id"]).join(objects.select(*keys, F.col("object_id").alias("major_id"), "schema_name", F.col("name").alias("object_name")), [*keys, "major_id"])
                 .join(columns.select(*keys, F.col("object_id").alias("major_id"), F.col("column_id").alias("minor_id"), F.col("name").alias("column_name")), [*keys, "major_id", "minor_id"], "left"))
    column = F.coalesce(F.concat(F.lit("("), bracket("column_name"), F.lit(")")), F.lit(""))
    object_level = rows(on_object, 9, F.concat(verb, F.lit(" "), F.col("permission_name"), F.lit(" ON "), bracket("schema_name"), F.lit("."), bracket("object_name"), column, to, tail))
    database_level = rows(granted.where(F.col("class") == 0).join(regular, [*keys, "grantee_id"]), 12, F.concat(verb, F.lit(" "), F.col("permission_name"), to, tail))
    on_schema = granted.where(F.col("class") == 3).join(user, [*keys, "grantee_id"]).join(schemas.select(*keys, F.col("schema_id").alias("major_id"), F.col("name").alias("schema_of")), [*keys, "major_id"])
    schema_level = rows(on_schema, 15, F.concat(verb, F.lit(" "), F.col("permission_name"), F.lit(" ON SCHEMA::"), bracket("schema_of"), to, tail))
    return reduce(DataFrame.unionByName, [head, people, member, object_level, database_level, schema_level]).distinct()


def linked_server_exposure(servers: DataFrame, linked_logins: DataFrame) -> DataFrame:
    """Linked servers that anyone can use, because the default mapping does not use the caller's own credentials."""
    keys = [*fleet_keys(servers, linked_logins), "server_id"]
    open_ = linked_logins.where((F.col("local_principal_id") == 0) & ~F.col("uses_self_credential"))
    usable = servers.where((F.col("server_id") != 0) & (F.col("is_data_access_enabled") | ~F.col("is_distributor")))
    return usable.join(open_.select(*keys), keys, "left_semi").select(*keys, "name", F.lit("open to every login").alias("details"))
