"""Retrieval queries: benchmark passages as queries over the documents, and vectors among themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.operators import search
from memspark.plans import mapping
from memspark.tables import table

C = F.col
EVERY = 20  # the stated query set of vector searches: ids divisible by it


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(C("item_id").alias("qid"), C("text").alias("query"))


def _records(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(C("doc_id").alias("id"), C("text").alias("content"))


def keyword(spark, sf_dir):
    return search.keyword_search(_queries(spark, sf_dir), _records(spark, sf_dir))


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.where(C("vec_id") % EVERY == 0).select(C("vec_id").alias("qid"), C("embedding").alias("q")), v.select(C("vec_id").alias("id"), C("embedding").alias("v"))


def vectors(spark, sf_dir):
    return search.vector_search(*_vectors(spark, sf_dir))


def vectors_l2(spark, sf_dir):
    return search.vector_search(*_vectors(spark, sf_dir), l2=True)


def hybrid(spark, sf_dir):
    """Keywords and hashed vectors as two arms of the benchmark items over the documents."""
    queries, records = _queries(spark, sf_dir), _records(spark, sf_dir)
    asked = search.hash_embedding(queries.select(C("qid").alias("id"), C("query").alias("content"))).select(C("id").alias("qid"), C("v").alias("q"))
    arm = lambda found, name: found.select("qid", F.lit(name).alias("arm"), "id", "rank", F.lit(0.0).alias("boost"))
    near = search.vector_search(asked, search.hash_embedding(records), 20)
    return search.fuse(arm(search.keyword_search(queries, records, 20), "keyword").unionByName(arm(near, "semantic")))


def embed(spark, sf_dir):
    found = search.hash_embedding(_records(spark, sf_dir))
    return found.select("id", F.posexplode("v").alias("at", "x")).where("x <> 0").select("id", "at", F.round("x", 6).alias("x"))


def temporal(spark, sf_dir):
    records = mapping.observations(spark, sf_dir).select("id", "category", C("valid_from").alias("since"))
    uses = table(spark, sf_dir, "events").select(C("user_id").alias("id"), C("ts").alias("at"))
    return search.temporal_boost(records, uses, "2024-06-01 00:00:00")


QUERIES = {
    "r1_keyword_search": keyword, "r2_vector_search": vectors, "r3_vector_search_l2": vectors_l2, "r4_hybrid_fusion": hybrid,
    "r7_temporal_boost": temporal, "r12_hash_embedding": embed,
}
_UNIT = "list_transform({v}, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform({v}, lambda y: CAST(y AS DOUBLE) ** 2))))"


def _cosine(width: int, k: int) -> str:
    v = f"embedding[1:{width}]"
    return f"""SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
      SELECT q.vec_id AS qid, v.vec_id AS id, round(list_dot_product(q.u, v.u), 6) AS score
      FROM (SELECT vec_id, {_UNIT.format(v=v)} AS u FROM embeddings) q JOIN (SELECT vec_id, {_UNIT.format(v=v)} AS u FROM embeddings) v ON q.vec_id % {EVERY} = 0) WHERE score > 0 QUALIFY rank <= {k}"""


ORACLE_SQL = {
    "r1_keyword_search": r"""
WITH t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS a FROM t),
q0 AS (SELECT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_-]+'), lambda x: strlen(x) > 1)) AS p FROM benchmark),
q AS (SELECT qid, p, count(*) AS times FROM q0 GROUP BY qid, p),
ph AS (SELECT DISTINCT p, list_filter(regexp_split_to_array(p, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS parts FROM q),
tok AS (SELECT id, len(w) AS dl, unnest(w) AS x, generate_subscripts(w, 1) AS pos FROM t),
one AS (SELECT p, id, dl, count(*) AS tf FROM tok JOIN ph ON len(parts) = 1 AND x = parts[1] GROUP BY p, id, dl),
two AS (SELECT p, id, dl, count(*) AS tf FROM (
  SELECT p, id, dl, pos - off AS st, len(parts) AS n, count(DISTINCT off) AS c FROM tok JOIN (SELECT p, parts, unnest(parts) AS part, generate_subscripts(parts, 1) AS off FROM ph WHERE len(parts) > 1) ON x = part GROUP BY ALL) WHERE c = n GROUP BY p, id, dl),
po AS (SELECT * FROM one UNION ALL SELECT * FROM two),
df AS (SELECT p, greatest(ln((n - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, any_value(a) AS a FROM po, s GROUP BY p, n),
r AS (SELECT qid, id, round(sum(times * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 6) AS score FROM q JOIN df USING (p) JOIN po USING (p) GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 10""",
    "r2_vector_search": _cosine(64, 10),
    "r3_vector_search_l2": f"""SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
      SELECT q.vec_id AS qid, v.vec_id AS id, round(1 / (1 + list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % {EVERY} = 0) QUALIFY rank <= 10""",
    "r7_temporal_boost": f"""WITH {mapping.OBSERVATIONS_SQL}, u AS (SELECT user_id AS id, count(*) AS n, max(ts) AS t FROM events GROUP BY user_id),
      x AS (SELECT o.id, category, (epoch(TIMESTAMP '2024-06-01') - floor(epoch(valid_from))) / 3600.0 AS age, coalesce(n, 0) AS n, coalesce((epoch(TIMESTAMP '2024-06-01') - floor(epoch(t))) / 3600.0, 0) AS last FROM observations o LEFT JOIN u USING (id)),
      y AS (SELECT id, CASE WHEN age <= 0 THEN 1 ELSE exp(-((age / CASE category WHEN 'progress' THEN 168 WHEN 'learned' THEN 1440 ELSE 720 END) ** CASE category WHEN 'progress' THEN 1.2 WHEN 'learned' THEN 0.7 ELSE 1.0 END::DOUBLE)) END AS f,
        n, least(ln(1 + n) / ln(9), 1) AS v, CASE WHEN last <= 0 THEN 1 ELSE exp(-(last / 168)) END AS r FROM x)
      SELECT id, round(1.0 / 46 * least(0.6 * f + 0.4 * CASE WHEN n = 0 THEN 0 ELSE least(0.6 * v + 0.4 * v * r, 1) END, 1), 8) AS boost FROM y""",
    "r12_hash_embedding": """WITH t AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS t FROM documents),
      h AS (SELECT id, sha256(t) AS h, count(*) AS n FROM t GROUP BY id, t),
      c AS (SELECT id, CAST(('0x' || h[15:16])::INT % 64 AS INT) AS "at", sum(CASE WHEN ('0x' || h[17:18])::INT % 2 = 0 THEN n ELSE -n END) AS x FROM h GROUP BY ALL)
      SELECT id, "at", round(x / sqrt(sum(x * x) OVER (PARTITION BY id)), 6) AS x FROM c QUALIFY x <> 0""",
}


def keyword_sql(k: int) -> str:
    return ORACLE_SQL["r1_keyword_search"].replace("QUALIFY rank <= 10", f"QUALIFY rank <= {k}")


def semantic_sql(k: int) -> str:
    """Hashed vectors of the benchmark items against those of the documents."""
    cells = """SELECT id, CAST(('0x' || h[15:16])::INT % 64 AS INT) AS slot, sum(CASE WHEN ('0x' || h[17:18])::INT % 2 = 0 THEN n ELSE -n END) AS x
      FROM (SELECT id, sha256(t) AS h, count(*) AS n FROM (SELECT {id} AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS t FROM {table}) GROUP BY id, t) GROUP BY ALL"""
    unit = "SELECT id, slot, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x FROM ({c}) QUALIFY x <> 0"
    q, d = unit.format(c=cells.format(id="item_id", table="benchmark")), unit.format(c=cells.format(id="doc_id", table="documents"))
    return f"""SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (
      SELECT q.id AS qid, d.id AS id, round(sum(q.x * d.x), 6) AS score FROM ({q}) q JOIN ({d}) d USING (slot) GROUP BY 1, 2) WHERE score > 0 QUALIFY rank <= {k}"""


_LOW = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The text boost of (qid, id) pairs ``p``, as the table ``boosts``.
BOOSTS_SQL = f"""boosts AS (SELECT qid, id, CASE WHEN q = '' THEN 0 ELSE CASE WHEN t = q THEN 0.020 WHEN contains(t, q) THEN 0.012 ELSE 0 END + CASE WHEN contains(s, q) THEN 0.008 ELSE 0 END
  + CASE WHEN len(w) > 0 THEN 0.006 * len(list_filter(w, lambda x: contains(t, x))) / len(w) + 0.004 * len(list_filter(w, lambda x: contains(s, x))) / len(w) ELSE 0 END END::DOUBLE AS boost
  FROM (SELECT qid, id, {_LOW.format(x='trim(b.text)')} AS q, {_LOW.format(x="split_part(d.text, chr(10), 1)")} AS t, {_LOW.format(x='d.text')} AS s,
    list_filter(regexp_split_to_array({_LOW.format(x='b.text')}, '[^a-z0-9]+'), lambda x: x <> '') AS w FROM (SELECT DISTINCT qid, id FROM p) JOIN benchmark b ON b.item_id = qid JOIN documents d ON d.doc_id = id))"""


def fused_sql(pool: int, k: int, boosted: bool) -> str:
    """Both arms of the benchmark items fused, with the text boost or without."""
    boost = "(SELECT qid, id, boost FROM boosts)" if boosted else "(SELECT DISTINCT qid, id, 0.0 AS boost FROM p)"
    return f"""WITH p AS (SELECT *, 1.10 AS w FROM ({keyword_sql(pool)}) UNION ALL SELECT *, 1.00 FROM ({semantic_sql(pool)})){', ' + BOOSTS_SQL if boosted else ''},
      f AS (SELECT qid, id, round(sum(w::DOUBLE / (45 + rank) + boost) + 0.018 * (count(*) - 1), 6)::DOUBLE AS score, min(rank) - 1 AS best_rank FROM p JOIN {boost} USING (qid, id) GROUP BY qid, id)
      SELECT qid, id, score, best_rank, row_number() OVER (PARTITION BY qid ORDER BY score DESC, best_rank, id) AS rank FROM f QUALIFY rank <= {k}"""


ORACLE_SQL["r4_hybrid_fusion"] = fused_sql(20, 10, False)
