"""op12: the prefix trie of all rebuilt conversations."""

from fleetlens.llm.prefix_trie import prefix_trie
from fleetlens.llm.queries import query, table

CHECK = r"""
WITH own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (
  SELECT *, (CAST(4294967295 AS BIGINT) - list_reduce(
    list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END),
    CAST(4294967295 AS BIGINT))) % 4 AS h
  FROM own),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
prefixes AS (SELECT conv_id, d AS depth, turns[1:d] AS prefix, d = len(turns) AS ends FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, prefix),
children AS (SELECT depth - 1 AS depth, prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(regexp_split_to_array(prefix[n.depth]['text'], '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS saved
  FROM nodes n LEFT JOIN children USING (depth, prefix)),
below AS (
  SELECT d AS depth, prefix[1:d] AS prefix, sum(CAST(n_children = 0 AS INTEGER)) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN below USING (depth, prefix) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]"""


@query("op12_conversation_trie", CHECK)
def op12_conversation_trie(spark, sf_dir):
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("turn_conv_id", "turn_pos")
