"""op4: near duplicates among all documents."""

from fleetlens.llm.near_dedup import near_duplicates
from fleetlens.llm.queries import query, table

CHECK = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[p:p + 4] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes m ON m.doc_id = a JOIN sizes o ON o.doc_id = b WHERE 100 * n_both >= 75 * (m.n + o.n - n_both)),
reach(doc_id, seen) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT b, seen FROM reach JOIN links ON a = reach.doc_id AND seen < b),
smallest AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN smallest USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


@query("op4_near_duplicates", CHECK)
def op4_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
