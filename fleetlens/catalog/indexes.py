"""Index queries over the given tables."""

from fleetlens.catalog.registry import FRAMES, query, rounded
from fleetlens.operators import index_catalog as ic, index_health as ih
from fleetlens.plans.ordering import reuse

R = rounded
AS_OF = "2001-12-01 00:00:00"

FRAMES.update(
    bf_table_columns="""SELECT DISTINCT o_custkey AS object_id, l_partkey % 6 + 1 AS column_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey""",
    bf_named_columns="""SELECT object_id, column_id, CONCAT('c', CAST(column_id AS VARCHAR(10))) AS name FROM bf_table_columns""",
    bf_typed_indexes="""
        SELECT i.object_id, i.index_id, i.is_unique, i.filter_definition, CASE WHEN i.index_id = f.first_index THEN 1 ELSE 2 END AS type, i.index_id % 11 = 0 AS is_primary_key,
            i.index_id % 13 = 0 AS is_unique_constraint
        FROM bf_indexes i JOIN (SELECT object_id, MIN(index_id) AS first_index FROM bf_indexes GROUP BY object_id) f ON i.object_id = f.object_id""",
    bf_index_rows="""SELECT o_custkey AS object_id, o_orderkey AS index_id, CAST(ROUND(o_totalprice) AS BIGINT) AS row_count FROM orders""",
    bf_order_index_usage="""SELECT o_custkey AS object_id, o_orderkey AS index_id, o_orderkey % 50 AS user_seeks, o_orderkey % 7 AS user_scans, o_custkey % 90 AS user_updates FROM orders""",
    bf_fk_columns="""
        SELECT l_orderkey AS constraint_object_id, l_linenumber AS constraint_column_id, l_partkey % 6 + 1 AS parent_column_id, CONCAT('c', CAST(l_partkey % 6 + 1 AS VARCHAR(10))) AS column_name
        FROM lineitem""",
    bf_customer_tables="""SELECT c_custkey AS object_id, c_name AS name FROM customer""",
    bf_dated_tables="""
        SELECT s_suppkey AS object_id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN TIMESTAMP '2001-11-20 00:00:00' ELSE TIMESTAMP '2000-01-01 00:00:00' END AS create_date FROM supplier""",
    bf_quiet_usage="""
        SELECT l_suppkey AS object_id, l_linenumber AS index_id, SUM(CASE WHEN l_returnflag = 'R' AND l_quantity > 49 THEN 1 ELSE 0 END) AS user_seeks,
            SUM(CASE WHEN l_returnflag = 'A' AND l_quantity > 49 THEN 1 ELSE 0 END) AS user_scans, SUM(CASE WHEN l_returnflag = 'N' AND l_quantity > 49 THEN 1 ELSE 0 END) AS user_lookups, COUNT(*) AS user_updates
        FROM lineitem GROUP BY l_suppkey, l_linenumber""",
    bf_line_partitions="""
        SELECT l_suppkey AS object_id, l_linenumber AS index_id, l_partkey % 3 + 1 AS partition_number, COUNT(*) AS row_count, SUM(CAST(l_quantity AS BIGINT)) AS used_page_count,
            SUM(CAST(l_quantity AS BIGINT)) + COUNT(*) AS reserved_page_count FROM lineitem GROUP BY l_suppkey, l_linenumber, l_partkey % 3 + 1""",
    bf_fk_references="""SELECT l_suppkey AS object_id, l_linenumber AS index_id, l_orderkey AS constraint_object_id FROM lineitem""",
    bf_line_index_columns="""
        SELECT l_suppkey AS object_id, l_linenumber AS index_id, l_partkey % 4 + 1 AS column_id, l_partkey % 4 + 1 AS key_ordinal, CASE WHEN l_partkey % 4 = 1 THEN 1 ELSE 0 END AS is_descending_key,
            CASE WHEN l_partkey % 4 = 3 THEN 1 ELSE 0 END AS is_included_column FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6""",
    bf_line_columns="""SELECT DISTINCT l_suppkey AS object_id, l_partkey % 4 + 1 AS column_id, CONCAT('c', CAST(l_partkey % 4 + 1 AS VARCHAR(10))) AS name FROM lineitem""",
    bf_all_stats="""
        SELECT p_partkey AS object_id, p_size AS stats_id, p_name AS name, p_size % 2 = 0 AS auto_created, p_size % 3 = 0 AS user_created, p_size % 5 = 0 AS has_filter FROM part""",
    bf_part_rows="""SELECT l_partkey AS object_id, l_linenumber % 3 AS index_id, COUNT(*) AS row_count FROM lineitem GROUP BY l_partkey, l_linenumber % 3""",
    bf_index_filegroups="""SELECT DISTINCT l_suppkey AS object_id, l_linenumber - 1 AS index_id, CONCAT('fg', CAST(l_linenumber % 3 AS VARCHAR(10))) AS filegroup_name FROM lineitem""",
    bf_design_columns="""
        SELECT p_partkey AS object_id, p_name AS name, CASE p_size % 8 WHEN 0 THEN 'sql_variant' WHEN 1 THEN 'text' WHEN 2 THEN 'float' WHEN 3 THEN 'varchar' WHEN 4 THEN 'uniqueidentifier' WHEN 5 THEN 'image' WHEN 6 THEN 'char' ELSE 'int' END AS type_name,
            p_size % 4 AS max_length, p_partkey % 9 <> 0 AS is_ansi_padded, p_size % 3 + 1 AS column_id FROM part""",
    bf_design_parameters="""
        SELECT p_partkey AS object_id, CONCAT('@', p_name) AS name, CASE p_size % 6 WHEN 0 THEN 'varchar' WHEN 1 THEN 'sql_variant' WHEN 2 THEN 'float' WHEN 3 THEN 'image' ELSE 'int' END AS type_name, p_size % 5 AS max_length FROM part""",
    bf_triggers="""SELECT s_suppkey AS object_id, s_name AS name FROM supplier WHERE s_acctbal < 0""",
    bf_constraints="""SELECT c_custkey AS object_id, c_name AS name, c_acctbal < 0 AS is_disabled FROM customer""",
    bf_views="""SELECT s_suppkey AS object_id, s_name AS name FROM supplier""",
    bf_part_typed_indexes="""SELECT p_partkey AS object_id, p_size % 3 AS index_id, p_name AS name, p_size % 3 AS type, p_partkey % 10 = 0 AS is_disabled FROM part""",
    bf_part_index_columns="""SELECT p_partkey AS object_id, p_size % 3 AS index_id, p_size % 3 + 1 AS column_id, 1 AS key_ordinal FROM part""",
    bf_part_partitions="""SELECT l_partkey AS object_id, l_linenumber % 2 AS index_id, COUNT(*) AS row_count, SUM(CAST(l_quantity AS BIGINT)) AS used_page_count FROM lineitem GROUP BY 1, 2""",
    bf_internal_tables="""SELECT p_partkey AS object_id, p_partkey % 500 AS parent_object_id FROM part WHERE p_size % 10 = 0""",
    bf_row_groups="""SELECT l_suppkey AS object_id, l_linenumber AS index_id, l_orderkey AS row_group_id, l_partkey % 900 AS total_rows, l_partkey % 100 AS deleted_rows FROM lineitem""",
    bf_partition_layouts="""SELECT s_suppkey AS object_id, s_suppkey % 10 AS function_id, s_suppkey % 4 + 4 AS fanout, s_suppkey % 2 = 0 AS boundary_on_right FROM supplier""",
    bf_range_values="""SELECT DISTINCT l_suppkey % 10 AS function_id, l_linenumber AS boundary_id, l_linenumber * 1000 AS value FROM lineitem""",
)

_LISTS = """
    k AS (SELECT object_id, index_id, LIST(CASE WHEN is_descending_key = 1 THEN -column_id ELSE column_id END ORDER BY key_ordinal, column_id) FILTER (is_included_column = 0) AS kc,
        LIST(column_id ORDER BY column_id) FILTER (is_included_column = 1) AS inc, LIST_SORT(LIST(DISTINCT column_id)) AS al FROM {source} GROUP BY 1, 2),
    x AS (SELECT k.object_id, k.index_id, COALESCE(kc, []) AS kc, COALESCE(inc, []) AS inc, al, COALESCE(filter_definition, '') AS f, type, is_unique, is_primary_key, is_unique_constraint
        FROM k JOIN bf_typed_indexes i ON k.object_id = i.object_id AND k.index_id = i.index_id)"""
_PHYSICAL = """
    a AS (SELECT c.*, 0 AS is_secret_column FROM (SELECT object_id, index_id, column_id, key_ordinal, is_descending_key, is_included_column FROM bf_index_columns) c
        UNION ALL SELECT i.object_id, i.index_id, c.column_id, CASE WHEN i.is_unique THEN 0 ELSE c.key_ordinal + 1000000 END, c.is_descending_key, CASE WHEN i.is_unique THEN 1 ELSE 0 END, 1
        FROM bf_typed_indexes i JOIN bf_typed_indexes t ON t.object_id = i.object_id AND t.type = 1 JOIN bf_index_columns c ON c.object_id = t.object_id AND c.index_id = t.index_id WHERE i.type = 2
        UNION ALL SELECT i.object_id, i.index_id, c.column_id, 0, 0, 1, 0 FROM bf_typed_indexes i JOIN bf_table_columns c ON c.object_id = i.object_id
        WHERE i.type = 1 AND NOT EXISTS (SELECT 1 FROM bf_index_columns d WHERE d.object_id = i.object_id AND d.index_id = i.index_id AND d.column_id = c.column_id)),
    ph AS (SELECT object_id, index_id, column_id, key_ordinal, is_descending_key, is_included_column, is_secret_column FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_id, index_id, column_id
        ORDER BY is_included_column, key_ordinal, is_secret_column, is_descending_key) AS rn FROM a) WHERE rn = 1)"""
_TXT = "ARRAY_TO_STRING({}, ',')"
_PAIR = """p AS (SELECT a.object_id, a.index_id AS pi, b.index_id AS ci, a.type AS pt, a.kc AS pk, b.kc AS ck, a.inc AS pinc, b.inc AS cinc, a.al AS pa, b.al AS ca, a.is_unique AS pu, b.is_unique AS cu, b.type AS ct,
        a.is_primary_key OR a.is_unique_constraint AS pcon, b.is_primary_key OR b.is_unique_constraint AS ccon
        FROM x a JOIN x b ON a.object_id = b.object_id AND a.index_id <> b.index_id AND LEN(b.kc) > 0 AND a.kc[1:LEN(b.kc)] = b.kc {extra})"""


def _physical(t):
    # in production these are landed tables; here they are derived, so once is enough
    return ic.physical_index_columns(reuse(t.typed_indexes), reuse(t.index_columns), t.table_columns)


def _lists(t):
    return ic.index_column_lists(_physical(t), t.typed_indexes)


def _defined(t):
    return ic.index_column_lists(t.index_columns, t.typed_indexes)


@query("i1_physical_index_columns", f"WITH {_PHYSICAL} SELECT CAST(object_id AS BIGINT) AS object_id, index_id, column_id, key_ordinal, is_descending_key, is_included_column, is_secret_column FROM ph")
def _(t):
    return _physical(t)


@query("i2_index_column_lists", f"""WITH {_PHYSICAL}, {_LISTS.format(source='ph')}
    SELECT object_id, index_id, {_TXT.format('kc')} AS key_columns, {_TXT.format('inc')} AS include_columns, {_TXT.format('al')} AS all_columns, CAST(LEN(kc) AS INTEGER) AS key_columns_count,
        CAST(LEN(inc) AS INTEGER) AS include_columns_count, CAST(LEN(al) AS INTEGER) AS all_columns_count, NULLIF(f, '') AS filter_definition, type, is_unique, is_primary_key, is_unique_constraint FROM x""")
def _(t):
    return ic.shared_columns(_lists(t))


@query("i2_column_list_text", """
    SELECT i.object_id, i.index_id, STRING_AGG('[' || name || ']' || CASE WHEN is_descending_key = 1 THEN ' DESC' ELSE '' END, ', ' ORDER BY key_ordinal, i.column_id) FILTER (is_included_column = 0) AS key_list,
        STRING_AGG('[' || name || ']', ', ' ORDER BY key_ordinal, i.column_id) FILTER (is_included_column = 1) AS include_list
    FROM bf_index_columns i JOIN bf_named_columns c ON i.object_id = c.object_id AND i.column_id = c.column_id GROUP BY 1, 2""")
def _(t):
    return ic.column_list_text(t.index_columns, t.named_columns)


@query("i3_normalise_filter", """
    SELECT id, '(' || ARRAY_TO_STRING(LIST_SORT(STRING_SPLIT(SUBSTRING(filter_definition, 2, LENGTH(filter_definition) - 2), ' AND ')), ' AND ') || ')' AS filter_definition FROM bf_filters""")
def _(t):
    return ic.normalise_filter(t.filters)


@query("i4_duplicate_indexes", f"""WITH {_PHYSICAL}, {_LISTS.format(source='ph')},
    d AS (SELECT *, MIN(index_id) OVER w AS group_id, COUNT(*) OVER w AS group_count FROM x WHERE type = 2 WINDOW w AS (PARTITION BY object_id, f, kc, inc))
    SELECT object_id, index_id, group_id, group_count, {_TXT.format('kc')} AS key_columns, {_TXT.format('inc')} AS include_columns FROM d WHERE group_count > 1""")
def _(t):
    return ic.duplicate_indexes(_lists(t))


_UNIQUE = "AND a.f = b.f AND ((a.is_unique AND a.kc = b.kc) OR (NOT a.is_unique AND NOT b.is_unique))"


@query("i5_covered_indexes", f"""WITH {_PHYSICAL}, {_LISTS.format(source='ph')}, {_PAIR.format(extra=_UNIQUE)},
    c AS (SELECT * FROM p WHERE ct <> 1 AND NOT ccon AND (pt = 1 OR (LEN(LIST_FILTER(ca, lambda v: NOT LIST_CONTAINS(pa, v))) = 0 AND (pk <> ck OR pa <> ca))))
    SELECT object_id, pi AS index_id, ci AS covered_index_id, {_TXT.format('pk')} AS key_columns, {_TXT.format('ck')} AS covered_key_columns, CAST(LEN(pa) - LEN(ca) AS INTEGER) AS column_difference,
        {_TXT.format('LIST_FILTER(LIST_CONCAT(LIST_TRANSFORM(pk, lambda v: ABS(v)), pinc), lambda v: NOT LIST_CONTAINS(ca, v))')} AS extra_columns
    FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.object_id = c.object_id AND d.ci = c.pi) AND LEN(pa) - LEN(ca) <= 5""")
def _(t):
    return ic.covered_indexes(_lists(t))


@query("i6_mergeable_indexes", f"""WITH {_PHYSICAL}, {_LISTS.format(source='ph')}, {_PAIR.format(extra=_UNIQUE)},
    m AS (SELECT *, LEN(LIST_FILTER(ca, lambda v: NOT LIST_CONTAINS(pa, v))) AS e FROM p WHERE pt = 2 AND ct = 2 AND NOT pcon AND NOT ccon AND (pk <> ck OR LEN(pinc) > 0)),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY object_id, LEAST(pi, ci), GREATEST(pi, ci) ORDER BY e, pi) AS rn FROM m WHERE e BETWEEN 1 AND 3)
    SELECT object_id, pi AS index_id, ci AS merged_index_id, CAST(e AS INTEGER) AS extra_column_count FROM r WHERE rn = 1""")
def _(t):
    return ic.mergeable_indexes(_lists(t))


@query("i7_redundant_indexes", f"""WITH {_LISTS.format(source='bf_index_columns')}, {_PAIR.format(extra="AND a.f = b.f")},
    n AS (SELECT object_id, index_id FROM bf_index_rows GROUP BY 1, 2 HAVING SUM(row_count) >= 100000),
    q AS (SELECT p.* FROM p JOIN n a ON a.object_id = p.object_id AND a.index_id = pi JOIN n b ON b.object_id = p.object_id AND b.index_id = ci
        WHERE ci <> 1 AND NOT cu AND (LEN(cinc) = 0 OR pinc[1:LEN(cinc)] = cinc))
    SELECT q.object_id, ci AS index_id, pi AS containing_index_id, {_TXT.format('ck')} AS key_columns, {_TXT.format('cinc')} AS include_columns, a.user_seeks, a.user_scans, a.user_updates,
        b.user_seeks AS containing_user_seeks, b.user_scans AS containing_user_scans, b.user_updates AS containing_user_updates,
        'DROP INDEX ' || CAST(ci AS VARCHAR) || ' ON ' || CAST(q.object_id AS VARCHAR) || ';' AS drop_command
    FROM q LEFT JOIN bf_order_index_usage a ON a.object_id = q.object_id AND a.index_id = ci LEFT JOIN bf_order_index_usage b ON b.object_id = q.object_id AND b.index_id = pi""")
def _(t):
    return ic.redundant_indexes(_defined(t), t.order_index_usage, t.index_rows, 100000)


@query("i8_redundant_long_short", f"""WITH {_LISTS.format(source='bf_index_columns')}, y AS (SELECT object_id, index_id, LIST_TRANSFORM(kc, lambda v: ABS(v)) AS kc, inc FROM x WHERE LEN(kc) > 0)
    SELECT a.object_id, a.index_id AS long_index_id, b.index_id AS short_index_id, {_TXT.format('a.kc')} AS long_keys, {_TXT.format('a.inc')} AS long_includes, {_TXT.format('b.kc')} AS short_keys,
        {_TXT.format('b.inc')} AS short_includes
    FROM y a JOIN y b ON a.object_id = b.object_id AND a.index_id <> b.index_id AND a.kc[1:LEN(b.kc)] = b.kc AND (LEN(b.inc) = 0 OR a.inc[1:LEN(b.inc)] = b.inc)
    WHERE LEN(a.kc) > LEN(b.kc) OR LEN(a.inc) > LEN(b.inc) OR a.index_id < b.index_id""")
def _(t):
    return ic.redundant_indexes_long_short(_defined(t))


@query("i9_unused_indexes", f"""
    WITH s AS (SELECT object_id, index_id, CAST(SUM(row_count) AS BIGINT) AS row_count, CAST(SUM(reserved_page_count) * 8 AS BIGINT) AS size_kb FROM bf_line_partitions GROUP BY 1, 2 HAVING SUM(row_count) > 50)
    SELECT i.object_id, i.index_id, t.name AS table_name, i.name AS index_name, row_count, size_kb, user_updates, create_date,
        'ALTER INDEX [' || i.name || '] ON [' || t.name || '] DISABLE;' AS disable_command, 'DROP INDEX [' || i.name || '] ON [' || t.name || '];' AS drop_command
    FROM bf_table_indexes i JOIN bf_quiet_usage u ON i.object_id = u.object_id AND i.index_id = u.index_id JOIN s ON i.object_id = s.object_id AND i.index_id = s.index_id JOIN bf_dated_tables t ON i.object_id = t.object_id
    WHERE user_seeks = 0 AND user_scans = 0 AND user_lookups = 0 AND user_updates > 20 AND i.index_id > 1 AND NOT is_primary_key AND NOT is_unique AND NOT is_disabled
        AND create_date < TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY""")
def _(t):
    return ih.unused_indexes(t.table_indexes, t.quiet_usage, t.line_partitions, t.dated_tables, AS_OF, 50, 20, 30)


_READS = "user_seeks + user_scans + user_lookups"


@query("i9_least_read_indexes", f"""
    SELECT i.object_id, i.index_id, name AS index_name, CAST({_READS} AS BIGINT) AS total_reads, CAST(user_updates AS BIGINT) AS user_updates
    FROM bf_table_indexes i JOIN bf_index_usage u ON i.object_id = u.object_id AND i.index_id = u.index_id WHERE type = 2 AND NOT is_primary_key AND NOT is_unique
    ORDER BY {_READS}, u.user_updates DESC, i.object_id, i.index_id LIMIT 25""")
def _(t):
    return ih.least_read_indexes(t.table_indexes, t.index_usage)


@query("i10_write_heavy_indexes", f"""
    SELECT i.object_id, i.index_id, name AS index_name, CAST(user_updates AS BIGINT) AS total_writes, CAST({_READS} AS BIGINT) AS total_reads, CAST(user_updates - ({_READS}) AS BIGINT) AS difference
    FROM bf_table_indexes i JOIN bf_index_usage u ON i.object_id = u.object_id AND i.index_id = u.index_id WHERE user_updates > {_READS} AND i.index_id > 1 AND type = 2 AND NOT is_primary_key AND NOT is_unique""")
def _(t):
    return ih.write_heavy_indexes(t.index_usage, t.table_indexes)


@query("i10_write_heavy_sized", f"""
    WITH s AS (SELECT object_id, index_id, {R('SUM(used_page_count)', '128', 2)} AS size_mb FROM bf_line_partitions GROUP BY 1, 2)
    SELECT i.object_id, i.index_id, name AS index_name, CAST(user_updates AS BIGINT) AS total_writes, CAST({_READS} AS BIGINT) AS total_reads, CAST(user_updates - ({_READS}) AS BIGINT) AS difference, size_mb
    FROM bf_table_indexes i JOIN bf_index_usage u ON i.object_id = u.object_id AND i.index_id = u.index_id JOIN s ON s.object_id = i.object_id AND s.index_id = i.index_id
    WHERE user_updates > {_READS} AND i.index_id > 1 AND {_READS} <> 0""")
def _(t):
    return ih.write_heavy_indexes(t.index_usage, t.table_indexes, t.line_partitions, some_reads=True)


@query("i11_index_usage", f"""
    SELECT i.object_id, i.index_id, name AS index_name, type, CAST(user_seeks AS BIGINT) AS user_seeks, CAST(user_scans AS BIGINT) AS user_scans, CAST(user_lookups AS BIGINT) AS user_lookups,
        CAST({_READS} AS BIGINT) AS total_reads, CAST(user_updates AS BIGINT) AS writes, user_seeks IS NULL AS never_used
    FROM bf_table_indexes i LEFT JOIN (SELECT * FROM bf_index_usage WHERE index_id <> 3) u ON i.object_id = u.object_id AND i.index_id = u.index_id""")
def _(t):
    return ih.index_usage(t.table_indexes, t.index_usage.where("index_id <> 3"))


def _fragmentation(policy, verdict, where):
    @query(f"i12_fragmentation_{policy}", f"""
        WITH f AS (SELECT u.object_id, u.index_id, t.name AS table_name, i.name AS index_name, avg_fragmentation_in_percent, page_count, {verdict} AS action
            FROM bf_index_usage u JOIN bf_table_indexes i ON i.object_id = u.object_id AND i.index_id = u.index_id JOIN bf_tables t ON t.object_id = u.object_id WHERE {where})
        SELECT *, 'ALTER INDEX [' || index_name || '] ON [' || table_name || '] ' || action || ';' AS command FROM f""")
    def _(t):
        return ih.fragmentation(t.index_usage, t.table_indexes, t.tables, policy)


_PCT = "avg_fragmentation_in_percent"
_fragmentation("listing", "CAST(NULL AS VARCHAR)", "page_count > 2500")
_fragmentation("fragmented", "CAST(NULL AS VARCHAR)", f"{_PCT} > 20 AND page_count > 1000")
_fragmentation("rebuild_40", f"CASE WHEN {_PCT} > 40 THEN 'REBUILD' END", "TRUE")
_fragmentation("reorganise_10_40", f"CASE WHEN page_count <= 1000 OR {_PCT} < 10 THEN NULL WHEN {_PCT} <= 40 THEN 'REORGANIZE' ELSE 'REBUILD' END", "TRUE")
_fragmentation("reorganise_30", f"CASE WHEN {_PCT} <= 30 THEN 'REORGANIZE' ELSE 'REBUILD' END", f"{_PCT} > 20 AND page_count > 1000")


@query("i13_index_metadata", f"""
    WITH s AS (SELECT object_id, index_id, SUM(used_page_count) * 8 AS kb, SUM(row_count) AS n FROM bf_line_partitions GROUP BY 1, 2),
    r AS (SELECT object_id, index_id, COUNT(*) AS n FROM bf_fk_references GROUP BY 1, 2),
    l AS (SELECT i.object_id, i.index_id, STRING_AGG('[' || name || ']' || CASE WHEN is_descending_key = 1 THEN ' DESC' ELSE '' END, ', ' ORDER BY key_ordinal, i.column_id) FILTER (is_included_column = 0) AS key_list,
        STRING_AGG('[' || name || ']', ', ' ORDER BY key_ordinal, i.column_id) FILTER (is_included_column = 1) AS include_list
        FROM bf_line_index_columns i JOIN bf_line_columns c ON i.object_id = c.object_id AND i.column_id = c.column_id GROUP BY 1, 2),
    b AS (SELECT i.*, t.name AS object_name, GREATEST(TIMESTAMP '2001-06-01 00:00:00', TIMESTAMP '2001-10-01 00:00:00', create_date - INTERVAL 2 HOUR) AS stats_begin FROM bf_table_indexes i JOIN bf_dated_tables t ON i.object_id = t.object_id)
    SELECT b.object_id, b.index_id, object_name, name AS index_name, stats_begin, DATE_DIFF('millisecond', stats_begin, TIMESTAMP '{AS_OF}') AS stats_age_ms, COALESCE(r.n, 0) > 0 AS has_fk_references,
        COALESCE(r.n, 0) AS fk_reference_count, CAST(user_seeks AS BIGINT) AS user_seeks, CAST(user_scans AS BIGINT) AS user_scans, CAST(user_lookups AS BIGINT) AS user_lookups, CAST(user_updates AS BIGINT) AS user_updates,
        CAST({_READS} AS BIGINT) AS read_count, CAST(row_lock_wait_in_ms + page_lock_wait_in_ms AS BIGINT) AS total_lock_wait_ms, last_user_seek - INTERVAL 2 HOUR AS last_read, CAST(s.kb AS BIGINT) AS size_kb,
        CAST(s.n AS BIGINT) AS row_count, key_list, include_list
    FROM b LEFT JOIN bf_index_usage u ON u.object_id = b.object_id AND u.index_id = b.index_id LEFT JOIN s ON s.object_id = b.object_id AND s.index_id = b.index_id
    LEFT JOIN r ON r.object_id = b.object_id AND r.index_id = b.index_id LEFT JOIN l ON l.object_id = b.object_id AND l.index_id = b.index_id""")
def _(t):
    lists = ic.column_list_text(t.line_index_columns, t.line_columns)
    return ih.index_metadata(t.table_indexes, t.dated_tables, t.line_partitions, t.index_usage, t.fk_references, lists, AS_OF, "2001-06-01 00:00:00", "2001-10-01 00:00:00", "+02:00")


@query("i14_foreign_keys_without_index", f"""WITH {_LISTS.format(source='bf_index_columns')},
    f AS (SELECT constraint_object_id, LIST(parent_column_id ORDER BY constraint_column_id, parent_column_id) AS fc, LIST(column_name ORDER BY constraint_column_id, parent_column_id) AS fn FROM bf_fk_columns GROUP BY 1),
    y AS (SELECT object_id, LIST_TRANSFORM(kc, lambda v: ABS(v)) AS kc FROM x WHERE LEN(kc) > 0)
    SELECT k.parent_object_id AS object_id, k.constraint_object_id, k.name AS foreign_key_name, t.name AS table_name, '[' || ARRAY_TO_STRING(fn, '], [') || ']' AS foreign_key_columns,
        'CREATE NONCLUSTERED INDEX [IX_' || ARRAY_TO_STRING(fn, '_') || '] ON [' || t.name || '] ([' || ARRAY_TO_STRING(fn, '], [') || ']);' AS create_index
    FROM bf_foreign_keys k JOIN f ON k.constraint_object_id = f.constraint_object_id LEFT JOIN bf_customer_tables t ON t.object_id = k.parent_object_id
    WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.object_id = k.parent_object_id AND (kc[1:LEN(fc)] = fc OR fc[1:LEN(kc)] = kc))""")
def _(t):
    return ic.foreign_keys_without_index(t.foreign_keys, t.fk_columns, _defined(t), t.customer_tables)


@query("i15_stale_statistics", f"""
    WITH p AS (SELECT object_id FROM bf_part_rows WHERE index_id <= 1 GROUP BY 1 HAVING SUM(row_count) >= 15)
    SELECT object_id, stats_id, MIN(last_updated) AS last_update, CAST(MAX(modification_counter) AS BIGINT) AS modification_counter,
        'UPDATE STATISTICS [' || CAST(object_id AS VARCHAR) || '] [' || CAST(stats_id AS VARCHAR) || '];' AS update_command
    FROM bf_stats WHERE modification_counter >= 100 AND last_updated < TIMESTAMP '{AS_OF}' - INTERVAL 35 DAY AND object_id IN (SELECT object_id FROM p) GROUP BY 1, 2""")
def _(t):
    return ih.stale_statistics(t.stats, t.part_rows, AS_OF, 15, 100, 35)


@query("i15_modified_statistics", f"""
    SELECT object_id, stats_id, last_updated, CAST(modification_counter AS BIGINT) AS modification_counter, row_count, {R('modification_counter', 'row_count', 2, 100)} AS modified_pct
    FROM bf_stats WHERE modification_counter > 0 AND last_updated < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY""")
def _(t):
    return ih.modified_statistics(t.stats, AS_OF)


@query("i15_labelled_statistics", """
    SELECT *, CASE WHEN NOT auto_created AND NOT user_created THEN 'Index Statistic' WHEN NOT auto_created THEN 'User Created' WHEN NOT user_created THEN 'Auto Created' ELSE 'Not Possible?' END AS statistic_type,
        CASE WHEN has_filter THEN 'Filtered Index' ELSE 'No Filter' END AS filtered FROM bf_all_stats""")
def _(t):
    return ih.labelled_statistics(t.all_stats)


@query("i16_volatile_statistics", """
    SELECT s.object_id, stats_id, last_updated, CAST(modification_counter AS BIGINT) AS modification_counter, row_count, name AS object_name FROM bf_stats s JOIN bf_part_objects o ON s.object_id = o.object_id
    WHERE modification_counter > 0""")
def _(t):
    return ih.volatile_statistics(t.stats, t.part_objects)


_SIZED = "FROM bf_partition_stats s JOIN bf_tables t ON s.object_id = t.object_id"


@query("i17_table_sizes_rows", f"""
    SELECT s.object_id, name AS table_name, CAST(SUM(row_count) AS BIGINT) AS row_count, {R('SUM(reserved_page_count)', '128', 2)} AS size_mb {_SIZED} WHERE index_id < 2 GROUP BY 1, 2""")
def _(t):
    return ih.table_sizes(t.partition_stats, t.tables, "rows")


@query("i17_table_sizes_space", f"""
    WITH a AS (SELECT s.object_id, name, SUM(CASE WHEN index_id < 2 THEN row_count ELSE 0 END) AS n, SUM(reserved_page_count) AS r, SUM(used_page_count) AS u {_SIZED} GROUP BY 1, 2)
    SELECT object_id, name AS table_name, CAST(n AS BIGINT) AS row_count, CAST(r * 8 AS BIGINT) AS total_kb, CAST(u * 8 AS BIGINT) AS used_kb, CAST((r - u) * 8 AS BIGINT) AS unused_kb, {R('r', '128', 2)} AS total_mb,
        {R('r', '131072', 3)} AS total_gb, CAST(u * 8192 // NULLIF(n, 0) AS BIGINT) AS bytes_per_row FROM a""")
def _(t):
    return ih.table_sizes(t.partition_stats, t.tables, "space")


@query("i17_table_sizes_partition", f"""
    SELECT s.object_id, s.index_id, CAST(partition_number AS INTEGER) AS partition_number, name AS table_name, filegroup_name, {R('used_page_count', '128', 2)} AS used_mb, {R('reserved_page_count', '128', 2)} AS reserved_mb,
        CASE WHEN s.index_id < 2 THEN row_count ELSE 0 END AS row_count, CASE WHEN s.index_id < 2 THEN 'data' ELSE 'index' END AS kind
    {_SIZED} LEFT JOIN bf_index_filegroups g ON g.object_id = s.object_id AND g.index_id = s.index_id""")
def _(t):
    return ih.table_sizes(t.partition_stats, t.tables, "partition", t.index_filegroups)


@query("i17_table_sizes_kind", f"""
    SELECT s.object_id, name AS table_name, CASE WHEN index_id < 2 THEN 'data' ELSE 'index' END AS kind, {R('SUM(used_page_count)', '128', 2)} AS used_mb {_SIZED} GROUP BY 1, 2, 3""")
def _(t):
    return ih.table_sizes(t.partition_stats, t.tables, "kind")


@query("i18_heap_tables", f"SELECT s.object_id, CAST(SUM(row_count) AS BIGINT) AS row_count, name AS table_name {_SIZED} WHERE index_id = 0 GROUP BY s.object_id, name")
def _(t):
    return ih.heap_tables(t.partition_stats, t.tables)


def _doubtful(what, source):
    return f"""SELECT object_id, name AS detail, CASE WHEN type_name = 'sql_variant' THEN '{what} with SQL_VARIANT data type' WHEN type_name IN ('text', 'image') THEN '{what} with deprecated data type'
        WHEN type_name = 'float' THEN '{what} with floating-point data type' ELSE 'Variable-length {what.lower()} with short max length' END AS finding FROM {source}
        WHERE type_name IN ('sql_variant', 'text', 'image', 'float') OR (type_name = 'varchar' AND max_length BETWEEN 1 AND 2)"""


@query("i19_design_findings", f"""
    SELECT object_id, name AS detail, 'trailing blanks of the column are not kept' AS finding FROM bf_design_columns WHERE NOT is_ansi_padded AND type_name IN ('char', 'varchar', 'text', 'image')
    UNION ALL {_doubtful('Column', 'bf_design_columns')} UNION ALL {_doubtful('Parameter', 'bf_design_parameters')}
    UNION ALL SELECT object_id, name, 'Trigger on user table' FROM bf_triggers UNION ALL SELECT object_id, name, 'Disabled constraint' FROM bf_constraints WHERE is_disabled
    UNION ALL SELECT object_id, name, 'Disabled index' FROM bf_table_indexes WHERE is_disabled
    UNION ALL SELECT object_id, name, 'Indexed view' FROM bf_views WHERE object_id IN (SELECT object_id FROM bf_table_indexes)""")
def _(t):
    return ih.design_findings(t.design_columns, t.design_parameters, t.triggers, t.constraints, t.table_indexes, t.views)


@query("i20_guid_leading_indexes", f"""
    WITH z AS (SELECT object_id, SUM(used_page_count) AS pages, SUM(row_count) AS n FROM bf_part_partitions WHERE index_id <= 1 GROUP BY 1
        UNION ALL SELECT i.parent_object_id, p.pages, 0 FROM bf_internal_tables i JOIN (SELECT object_id, SUM(used_page_count) AS pages FROM bf_part_partitions GROUP BY 1) p ON i.object_id = p.object_id),
    s AS (SELECT object_id, SUM(pages) AS pages, SUM(n) AS n FROM z GROUP BY 1 HAVING SUM(pages) > 4 * 128)
    SELECT i.object_id, i.index_id, i.name AS index_name, {R('pages', '128', 2)} AS size_mb, CAST(s.n AS BIGINT) AS row_count FROM bf_part_typed_indexes i JOIN s ON i.object_id = s.object_id
    WHERE type IN (1, 2) AND NOT is_disabled AND EXISTS (SELECT 1 FROM bf_part_index_columns x JOIN bf_design_columns c ON x.object_id = c.object_id AND x.column_id = c.column_id
        WHERE x.object_id = i.object_id AND x.index_id = i.index_id AND key_ordinal = 1 AND type_name = 'uniqueidentifier')""")
def _(t):
    return ih.guid_leading_indexes(t.part_typed_indexes, t.part_index_columns, t.design_columns, t.part_partitions, t.internal_tables, 4)


@query("i21_columnstore_fragmentation", """
    SELECT r.*, name AS index_name, deleted_rows * 100 // NULLIF(total_rows, 0) AS fragmentation FROM bf_row_groups r JOIN bf_table_indexes i ON r.object_id = i.object_id AND r.index_id = i.index_id""")
def _(t):
    return ih.columnstore_fragmentation(t.row_groups, t.table_indexes)


@query("i21_memory_index_usage", """
    SELECT i.object_id, i.index_id, name AS index_name, u.* EXCLUDE (object_id, index_id) FROM bf_table_indexes i
    JOIN (SELECT object_id, index_id, CAST(user_scans AS BIGINT) AS scans_started, CAST(user_seeks AS BIGINT) AS rows_returned FROM bf_index_usage) u ON u.object_id = i.object_id AND u.index_id = i.index_id""")
def _(t):
    stats = t.index_usage.selectExpr("object_id", "index_id", "user_scans AS scans_started", "user_seeks AS rows_returned")
    return ih.memory_index_usage(t.table_indexes, stats)


@query("i22_last_partitions_not_empty", """
    WITH n AS (SELECT p.object_id, index_id, partition_number, fanout, row_count, function_id, CASE WHEN boundary_on_right THEN partition_number - 1 ELSE partition_number END AS b
        FROM bf_partition_stats p JOIN bf_partition_layouts l ON p.object_id = l.object_id WHERE row_count > 0 AND partition_number > 1 AND index_id <= 1 AND fanout - partition_number <= 2)
    SELECT object_id, index_id, CAST(partition_number AS INTEGER) AS partition_number, fanout, value AS last_boundary, row_count, 'Table ' || CAST(object_id AS VARCHAR) || ' partition "' || CAST(partition_number AS VARCHAR) || '" out of "' ||
        CAST(fanout AS VARCHAR) || '" is not empty' || COALESCE(' (boundary range "' || CAST(value AS VARCHAR) || '")', '') AS message
    FROM n LEFT JOIN bf_range_values r ON r.function_id = n.function_id AND r.boundary_id = n.b""")
def _(t):
    return ih.last_partitions_not_empty(t.partition_stats, t.partition_layouts, t.range_values)


@query("i23_table_properties", """
    SELECT t.object_id, name, create_date, CAST(SUM(row_count) AS BIGINT) AS row_count, COUNT(*) AS partitions FROM bf_dated_tables t JOIN bf_partition_stats p ON t.object_id = p.object_id WHERE index_id < 2 GROUP BY 1, 2, 3""")
def _(t):
    return ih.table_properties(t.dated_tables, t.partition_stats, ["create_date"])
