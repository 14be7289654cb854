"""op11: secrets of every document, with parts of credentials that stand together."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from memspark.llm.secrets import SCOPE, STRONG, WEAK, digests, scan
from memspark.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _quoted(pattern: str) -> str:
    """The pattern for SQL: names in either case, of ASCII letters only, and without looks around, which only speed it up."""
    either = re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", pattern)
    return "'" + re.sub(r"\(\?(=|<!)\[[^]]*\]\)", "", either).replace("'", "''") + "'"


# what lies between the matches of a pattern, and their lengths, give their places
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {kind} AS kind, regexp_extract_all(t, {_quoted(rx)}, 0) AS m, regexp_split_to_array(t, {_quoted(rx)}) AS g, regexp_extract_all(t, {_quoted(rx)}, {group}) AS v FROM d WHERE regexp_matches(t, {_quoted(rx)})"
    for kind, (rx, group) in enumerate([(rx, group) for _, rx, group, _ in STRONG] + [(rx, 0) for _, rx, _ in WEAK])
)
_HOLDS = " AND ".join(
    [f"(kind <> {kind} OR length(v) >= {least})" for kind, (_, _, _, least) in enumerate(STRONG)] + [f"(kind <> {len(STRONG) + kind} OR regexp_matches(v, {_quoted(rx)}))" for kind, (_, _, rx) in enumerate(WEAK) if rx]
)
_NAMES = "[" + ", ".join(f"'{k[0]}'" for k in STRONG + WEAK) + "]"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({_FOUND}),
x AS (SELECT *, generate_subscripts(m, 1) AS i FROM f),
p AS (
  SELECT doc_id, kind, v[i] AS v, CAST(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0) AS BIGINT) AS a, length(m[i]) AS n FROM x
), s AS (SELECT doc_id, kind, a, a + n AS b FROM p WHERE {_HOLDS}),
c AS (
  SELECT * FROM s WHERE kind < {len(STRONG)}
  UNION ALL SELECT * FROM s w WHERE kind >= {len(STRONG)} AND NOT EXISTS (FROM s o WHERE o.doc_id = w.doc_id AND o.kind < {len(STRONG)} AND o.a < w.b AND w.a < o.b)
), k AS (
  SELECT * FROM c WHERE kind < {len(STRONG)}
  UNION ALL SELECT * FROM c w WHERE kind >= {len(STRONG)} AND EXISTS (
    FROM c o WHERE o.doc_id = w.doc_id AND (o.kind IN (0, 2, 4)) <> (w.kind IN (0, 2, 4)) AND (o.b BETWEEN w.a - {SCOPE} AND w.a OR o.a BETWEEN w.b AND w.b + {SCOPE})
  )
), r AS (SELECT doc_id, kind, a, ({_NAMES})[kind + 1] || ':' || a || ':' || b AS span FROM k)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY a, kind) FILTER (WHERE kind < {len(STRONG)}), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
"""
