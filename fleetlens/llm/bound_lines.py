"""op7: repeated lines of all documents."""

from fleetlens.llm.line_dedup import repeated_lines
from fleetlens.llm.queries import query, table

CHECK = r"""
WITH lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, l[i] AS line
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
  WHERE regexp_matches(l[i], '[^\x20\x09-\x0D]')),
firsts AS (SELECT line, min({'d': doc_id, 'n': line_no}) AS f FROM lines GROUP BY line),
halves AS (
  SELECT line, f, m, half, CASE WHEN half = 0 THEN left(line, m // 2) ELSE right(line, m // 2) END AS part
  FROM (SELECT line, f, unnest([len(line), len(line) - 1]) AS m FROM firsts WHERE len(line) >= 20), (VALUES (0), (1)) AS h(half)),
met AS (
  SELECT DISTINCT x.line AS line, x.f AS f, y.line AS other, y.f AS other_f
  FROM halves x JOIN halves y ON x.m = y.m AND x.half = y.half AND x.part = y.part AND x.line <> y.line AND y.f < x.f),
near AS (
  SELECT line, min(other_f) AS f FROM met
  WHERE CASE len(line) - len(other)
    WHEN 0 THEN len(list_filter(range(1, len(line) + 1), lambda i: line[i] <> other[i])) = 1
    WHEN 1 THEN len(list_filter(range(1, len(line) + 1), lambda i: left(line, i - 1) || substr(line, i + 1) = other)) > 0
    WHEN -1 THEN len(list_filter(range(1, len(other) + 1), lambda i: left(other, i - 1) || substr(other, i + 1) = line)) > 0
    ELSE false END
  GROUP BY line),
earliest AS (SELECT line, least(firsts.f, coalesce(near.f, firsts.f)) AS e FROM firsts LEFT JOIN near USING (line))
SELECT doc_id, line_no, e.d AS earlier_id, e.n AS earlier_line, e.d = doc_id AND e.n = line_no AS kept FROM lines JOIN earliest USING (line)"""


@query("op7_line_dedup", CHECK)
def op7_line_dedup(spark, sf_dir):
    return repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
