"""op1: all pages judged by five rules and their aliases."""

from fleetlens.llm.queries import query, table
from fleetlens.llm.url_filters import ALLOW, BLOCK, judge_urls

RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))

_NODE = """CASE WHEN contains({u}, '://') THEN {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"""
_REST = "substr({u}, instr({u}, '://') + 3)"


def _node(u: str) -> str:
    rest = _REST.format(u=u)
    host = rf"translate(regexp_extract({rest}, '\A[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = rf"regexp_extract({rest}, '\A[^/?#]*([^?#]*)', 1)"
    kept = rf"array_to_string(list_filter(string_split(regexp_extract({rest}, '\A[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_[a-z]+|gclid|fbclid|msclkid)=')), '&')"
    return _NODE.format(u=u, host=host, path=path, query=kept)


CHECK = rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
parts AS (
  SELECT page_id, url, html, {_node("url")} AS node,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract({_REST.format(u="url")}, '\A[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract({_REST.format(u="url")}, '\A[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
tags AS (SELECT node, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM parts),
targets AS (
  SELECT node, CASE WHEN tag ILIKE '<link%' AND regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s>]*)', 1)
    WHEN tag ILIKE '<meta%' AND regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''>]*)', 1) END AS t
  FROM tags),
links AS (SELECT DISTINCT node AS a, {_node("t")} AS b FROM targets WHERE regexp_matches(t, '(?i)\Ahttps?://')),
nodes AS (SELECT node, regexp_extract(node, '\A([^/?]*)', 1) AS host, regexp_extract(node, '\A[^/?]*([^?]*)', 1) AS path
          FROM (SELECT node FROM parts UNION SELECT a FROM links UNION SELECT b FROM links) WHERE node IS NOT NULL),
fits AS (
  SELECT node, r.host || r.path AS rule, verdict,
    row_number() OVER (PARTITION BY node ORDER BY len(r.host || r.path) DESC, verdict, r.host || r.path) AS k
  FROM nodes n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)),
reach(node, seen) AS (
  SELECT node, node FROM nodes
  UNION SELECT CASE WHEN a = reach.node THEN b ELSE a END, seen FROM reach JOIN links ON a = reach.node OR b = reach.node),
classes AS (SELECT node, min(seen) AS alias_class FROM reach GROUP BY node),
decided AS (
  SELECT alias_class, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked
  FROM classes JOIN fits ON classes.node = fits.node AND k = 1 GROUP BY alias_class)
SELECT page_id, p.host, p.path, f.rule, c.alias_class,
  coalesce(f.verdict, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM parts p LEFT JOIN fits f ON f.node = p.node AND k = 1 LEFT JOIN classes c ON c.node = p.node LEFT JOIN decided d ON d.alias_class = c.alias_class"""


@query("op1_url_filters", CHECK)
def op1_url_filters(spark, sf_dir):
    rules = spark.createDataFrame([(host, path, verdict) for verdict, host, path in RULES], "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)
