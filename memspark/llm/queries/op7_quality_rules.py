"""op7: the rule table over every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm.quality_rules import STOP_WORDS, apply_rules
from memspark.tables import table

COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*COLUMNS)


_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l
  FROM documents
), k AS (
  SELECT *, len(w) AS n_words,
    CASE WHEN len(w) < 8 THEN []::VARCHAR[] ELSE list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')) END AS g
  FROM t
), g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c
  FROM (SELECT doc_id, unnest(g) AS x, generate_subscripts(g, 1) AS i FROM k)
), r AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE c > 1) GROUP BY doc_id
), m AS (
  SELECT k.doc_id, n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
    len(list_filter(l, lambda x: ltrim(x)[1] IN ('•', '-', '*'))) AS n_bullet,
    len(list_filter(l, lambda x: rtrim(x) LIKE '%...' OR rtrim(x) LIKE '%…')) AS n_ellipsis
  FROM k LEFT JOIN r USING (doc_id)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * word_chars > 1200 * n_words OR 100 * word_chars < 200 * n_words
    OR 100 * n_symbols > 25 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_bullet > 90 * n_lines
    OR 100 * n_ellipsis > 30 * n_lines OR (n_words >= 50 AND 100 * n_stop < 2 * n_words)) AS kept
FROM b
"""
