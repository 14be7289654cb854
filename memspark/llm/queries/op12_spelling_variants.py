"""op12: spelling variants over all documents, and the forms that they lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm.spelling import spelling_variants
from memspark.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


# crc32 byte by byte over the table of its polynomial; words near each other by what deleting a character gives
SQL = """
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{5,}')) AS run FROM documents
), d AS (SELECT doc_id, run, count(*) AS n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS x FROM runs GROUP BY doc_id, run),
b AS (SELECT run, n, list_transform(range(len(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)) AS b FROM d),
h AS (SELECT run, n, xor(list_reduce([4294967295] || b, lambda c, y: xor(c // 256, tab.t[1 + xor(c % 256, y)])), 4294967295) AS h FROM b, tab),
w AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY word HAVING length(word) >= 5 AND sum(n) >= 3
), v AS (SELECT word, i, word[:i] || word[i + 2:] AS k FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
p AS (
  SELECT a.word, b.word AS other FROM v a JOIN v b ON a.k = b.k AND a.i = b.i AND a.word <> b.word
  UNION SELECT v.word, w.word FROM v JOIN w ON v.k = w.word UNION SELECT w.word, v.word FROM v JOIN w ON v.k = w.word
), q AS (SELECT p.word, count(*) AS n_near, min((-w.n, encode(p.other), p.other)) AS best FROM p JOIN w ON w.word = p.other GROUP BY p.word),
f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * n THEN best[3] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END AS form_n FROM w LEFT JOIN q USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
last AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN last USING (word)
"""
