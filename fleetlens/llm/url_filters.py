"""URL filters over classes of equivalent addresses.

A rule is a host with a path, to allow or to block; it fits its host and all subdomains where the address's path
starts with its own, and of the rules that fit the longest wins (of two of one length allow, then the first by code
point). An address without a rule takes the decision of its aliases: redirects (`<meta http-equiv="refresh">`) and
canonical links are edges between addresses, and connected components over them are the classes. A class with a blocked
member is blocked, unless one of its members is explicitly allowed: an explicit allow has precedence, on the address
itself and over a block that an alias would hand on. Everything else is allowed.

Two addresses that differ in scheme, fragment or tracking parameters only are one node, so they need no edge. Targets
that are no page themselves are nodes too, and rules judge them.

Rules of any number are matched by equality, never one by one: hosts meet the rules of their suffixes and learn which
path lengths occur there, and only prefixes of these lengths are looked up. Distinct nodes are judged, not pages, and a
host that a third of the pages share is one row in that step. Components are found by contraction.

Defined results: an address that is null or has no `://` has empty host and path, no rule, no alias, and is allowed. A page
without html has no edges. Edges to addresses that are no web addresses are ignored. Repeated pages are judged alike;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.components import components
from fleetlens.llm.storage import settled

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Query parameters that say where a visit came from and not what it is to.
TRACKING = r"(?i)^(utm_[a-z]+|gclid|fbclid|msclkid)="


def _rest(url: Column) -> Column:
    """What follows the first `://`; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"\A[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), r"\A[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The name that all spellings of an address share: host, path and the query without tracking parameters."""
    query = F.regexp_extract(_rest(url), r"\A[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.rlike(TRACKING) & (x != "")), "&")
    return F.when(_rest(url).isNotNull(), F.concat(host_of(url), path_of(url), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def _target(url: Column, link: Column) -> Column:
    """A link of a page as an address of its own; null for what is none (`mailto:` and the like)."""
    scheme = F.concat(F.substring(url, F.lit(1), F.instr(url, "://") - 1), F.lit("://"))
    folder = F.regexp_replace(path_of(url), r"[^/]*\z", "")
    page = F.concat(scheme, host_of(url), F.when(folder == "", "/").otherwise(folder))
    return (F.when((link == "") | _rest(url).isNull(), None)
            .when(link.rlike(r"(?i)\Ahttps?://"), link)
            .when(link.startswith("//"), F.concat(F.regexp_extract(scheme, r"\A[^/]*", 0), link))
            .when(link.rlike(r"\A[^/?#]*:"), None)
            .when(link.startswith("/"), F.concat(scheme, host_of(url), link))
            .when(link.startswith("?"), F.concat(scheme, host_of(url), path_of(url), link))
            .when(link.startswith("#"), None)
            .otherwise(F.concat(page, link)))


def _attribute(tag: Column, name: str) -> Column:
    value = rf"""(?is)\s{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.trim(F.concat(*[F.regexp_extract(tag, value, k) for k in (2, 3, 4)]))


def alias_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The pairs (a, b) of nodes that redirects and canonical links join."""
    # the tags are only looked for where the words occur
    lower = F.lower(F.col(html))
    rows = pages.where(F.contains(lower, F.lit("canonical")) | F.contains(lower, F.lit("refresh"))).select(
        F.col(url).alias("url"), F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)).alias("tag"))
    canonical = F.when(_attribute(F.col("tag"), "rel").rlike(r"(?i)(\A|\s)canonical(\s|\z)"), _attribute(F.col("tag"), "href"))
    content = _attribute(F.col("tag"), "content")
    refresh = F.when(F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh", F.trim(F.regexp_extract(content, r"""(?is)\burl\s*=\s*["']?([^"']*)""", 1)))
    link = F.coalesce(F.when(F.col("tag").rlike(r"(?i)\A<link"), canonical), F.when(F.col("tag").rlike(r"(?i)\A<meta"), refresh))
    rows = rows.select(node_of(F.col("url")).alias("a"), node_of(_target(F.col("url"), link)).alias("b"))
    return rows.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def match_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule and verdict of every row of (node, host, path) that a rule fits; rules are rows of (host, path, verdict)."""
    lengths = rules.groupBy(F.col("host").alias("rule_host")).agg(F.collect_set(F.length("path")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = nodes.select("host").distinct().select("host", F.explode(suffixes).alias("rule_host")).join(lengths, "rule_host")
    hosts = hosts.select("host", "rule_host", F.explode("lengths").alias("size"))
    prefixes = nodes.join(hosts, "host").where(F.length("path") >= F.col("size")).select("node", "rule_host", F.substring(F.col("path"), F.lit(1), F.col("size")).alias("prefix"))
    found = prefixes.join(rules, (F.col("rule_host") == F.col("host")) & (F.col("prefix") == rules["path"]))
    rule = F.concat("rule_host", "prefix")
    best = F.min_by(F.struct(rule.alias("rule"), F.col("verdict")), F.struct(-F.length(rule), F.col("verdict"), rule))
    return found.groupBy("node").agg(best.alias("x")).select("node", "x.rule", "x.verdict")


def judge_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Every page with host, path, the rule that fits its address (or null), the class of the address (the smallest node) and the verdict."""
    rows = pages.select(F.col(key).alias("key"), node_of(F.col(url)).alias("node"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    links = settled(alias_links(pages, url, html), "url-links")
    ends = links.select(F.explode(F.array("a", "b")).alias("node"))
    part = F.regexp_extract("node", r"\A([^/?]*)([^?]*)", 1), F.regexp_extract("node", r"\A([^/?]*)([^?]*)", 2)
    nodes = rows.select("node").unionAll(ends).where("node IS NOT NULL").distinct().select("node", part[0].alias("host"), part[1].alias("path"))
    place = components(links, label="urls")
    known = settled(nodes.join(match_rules(nodes, rules), "node", "left").join(place, "node", "left")
                    .select("node", "rule", "verdict", F.coalesce("component", "node").alias("class")), "url-nodes")
    classes = known.groupBy("class").agg(F.max(F.col("verdict") == ALLOW).alias("allowed"), F.max(F.col("verdict") == BLOCK).alias("blocked"))
    handed = F.when(F.col("allowed"), ALLOW).when(F.col("blocked"), BLOCK).otherwise(ALLOW)
    judged = known.join(classes, "class").select(F.col("node").alias("judged"), "rule", "class", F.coalesce("verdict", handed).alias("verdict"))
    out = rows.join(judged, rows["node"] == judged["judged"], "left")
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(ALLOW)).alias("verdict"), F.col("class").alias("alias_class"))
