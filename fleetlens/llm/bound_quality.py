"""op9: quality rules over all documents."""

from fleetlens.llm.quality_rules import FURNITURE, FURNITURE_WORDS, SENTENCE_ENDS, TRAIL_MARKS, quality_rules
from fleetlens.llm.queries import query, table


def _texts(values) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in values)


CHECK = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM texts),
windows AS (
  SELECT doc_id, p, w[p:p + 4] AS five FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM words)),
repeated AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, five) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(5, coalesce(p - before, 5))) AS n
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM repeated) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, w, len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols
  FROM (SELECT doc_id, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts))
  WHERE len(w) > 0),
judged AS (
  SELECT doc_id, len(w) AS n,
    right(w[-1], 1) NOT IN ({_texts(SENTENCE_ENDS)}) OR symbols * 10 > len(line)
    OR len(regexp_replace(line, '[^{"".join(TRAIL_MARKS)}]', '', 'g')) >= 3
    OR len(w) <= {FURNITURE_WORDS} AND list_bool_or(list_transform([{_texts(FURNITURE)}], lambda x: contains(lower(line), x))) AS fails
  FROM lines),
left_over AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE fails) AS n_failed_lines, coalesce(sum(n) FILTER (WHERE NOT fails), 0) AS n_words_left
  FROM judged GROUP BY doc_id),
repeats AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
base AS (
  SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(r.n, 0) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, CAST(coalesce(n_words_left, 0) AS BIGINT) AS n_words_left
  FROM texts JOIN words USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN covered c USING (doc_id) LEFT JOIN left_over USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_failed_lines, n_words_left,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - n_words_left) <= 50 * n_words AS kept
FROM base"""


@query("op9_quality_rules", CHECK)
def op9_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "clean_text")
