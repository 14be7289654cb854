"""op9: every document without its copied lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm.line_dedup import dedup_lines
from memspark.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Two lines are within one edit if their common prefix and common suffix cover all but one character of the longer.
SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents
), big AS (SELECT doc_id, pos, t FROM l WHERE ltrim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''),
d AS (SELECT t, length(t) AS n, min((doc_id, pos)) AS o FROM big GROUP BY t),
k AS (
  SELECT t, o, n, n AS c, 0 AS s, t[1:n // 2] AS part FROM d UNION ALL SELECT t, o, n, n, 1, t[n // 2 + 1:] FROM d
  UNION ALL SELECT t, o, n, n - 1, 0, t[1:(n - 1) // 2] FROM d UNION ALL SELECT t, o, n, n - 1, 1, t[(n - 1) // 2 + 2:] FROM d
), p AS (SELECT DISTINCT a.t, a.n, b.t AS u, b.n AS m FROM k a JOIN k b ON a.c = b.c AND a.s = b.s AND a.part = b.part AND b.o < a.o AND abs(a.n - b.n) <= 1),
e AS (
  SELECT t, greatest(n, m) AS most,
    coalesce(list_position(list_transform(range(1, least(n, m) + 1), lambda i: t[i] = u[i]), false) - 1, least(n, m)) AS pre,
    coalesce(list_position(list_transform(range(1, least(n, m) + 1), lambda i: t[n + 1 - i] = u[m + 1 - i]), false) - 1, least(n, m)) AS suf
  FROM p
), near AS (SELECT DISTINCT t FROM e WHERE pre + suf >= most - 1),
gone AS (SELECT big.doc_id, big.pos FROM big JOIN d USING (t) WHERE (big.doc_id, big.pos) <> d.o OR t IN (SELECT t FROM near))
SELECT x.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(r.text, '') END AS text,
  CAST(coalesce(len(string_split(x.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed
FROM documents x
LEFT JOIN (SELECT doc_id, string_agg(t, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id) r USING (doc_id)
LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)
"""
SQL = SQL.replace("CASE WHEN text IS NULL", "CASE WHEN x.text IS NULL")
