"""Queries of the vector index, typed keyword search, promotion, embedding life cycle, snapshots, chains of parents, crossing edges and transcripts in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark.operators import embed, graph, promote, vectors
from memspark.operators.search import top
from memspark.plans import assist, mapping
from memspark.queries import retrieval
from memspark.sources import transcript_table
from memspark.tables import table

C = F.col
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


# retrieval


@register("r3_vector_index")
def r3(spark, sf_dir):
    """Every 20th vector over the index of cells; a test holds its recall against r3_vector_search_l2."""
    v = table(spark, sf_dir, "embeddings")
    queries = v.where(C("vec_id") % retrieval.EVERY == 0).select(C("vec_id").alias("qid"), C("embedding").alias("q"))
    return vectors.search_vectors(queries, vectors.build_vector_index(v.select(C("vec_id").alias("id"), C("embedding").alias("v"), "label")))


_TYPES = {"entity": "es", "observation": "en", "decision": "fr", "context": "de"}


def _typed_sql() -> str:
    one = retrieval.ORACLE_SQL["r1_keyword_search"]
    parts = []
    for i, (kind, lang) in enumerate(_TYPES.items()):
        sql = one.replace("FROM documents)", f"FROM documents WHERE lang = '{lang}')", 1)
        sql = sql.replace("FROM q JOIN df USING (p) JOIN po USING (p) GROUP BY qid, id", "FROM q JOIN df USING (p) JOIN po USING (p) JOIN documents d ON d.doc_id = id AND (length(coalesce(d.source, '')) + qid) % 3 > 0 GROUP BY qid, id")
        parts.append(f"SELECT qid, {i} AS s, '{kind}' AS record_type, id, rank AS r FROM ({sql})")
    return f"SELECT qid, record_type, CAST(id AS VARCHAR) AS id, row_number() OVER (PARTITION BY qid ORDER BY s, r, id) AS rank FROM ({' UNION ALL '.join(parts)}) QUALIFY rank <= 10"


@register("r1_record_search", _typed_sql())
def r1_types(spark, sf_dir):
    """Four record types (documents by language), of which a query sees the scopes (sources) that its number allows."""
    d = table(spark, sf_dir, "documents").select(C("doc_id").alias("id"), C("text").alias("content"), F.coalesce("source", F.lit("")).alias("scope"), "lang")
    queries = table(spark, sf_dir, "benchmark").select(C("item_id").alias("qid"), C("text").alias("query"))
    scopes = d.select("scope").distinct().withColumn("_n", F.length("scope"))
    allowed = queries.select("qid", F.explode(F.array(*map(F.lit, range(3)))).alias("_m")).where((C("_m") + C("qid")) % 3 > 0).join(scopes.withColumn("_m", C("_n") % 3), "_m").select("qid", "scope")
    return embed.record_search(queries, {kind: d.where(C("lang") == lang).drop("lang") for kind, lang in _TYPES.items()}, 10, allowed)


# curation

_PAYLOADS = [
    ("entity", '{"name": "n{k}", "observe": "seen {k}"}'), ("observation", '{"title": "t{k}", "content": "c{k}", "supersedes": 7}'), ("decision", '{"title": "d{k}", "reasoning": ["a"], "content": "r{k}"}'),
    ("context", '{"id": "c{k}", "title": "x", "body": "text {k}"}'), ("state", '{"key": "s{k}", "title": "y", "status": null, "priority": true}'), ("state", '{"key": " ", "title": "y{k}"}'),
    ("theme", '{"name": "n{k}"}'), ("observation", '{"name": {"a": 1}, "content": "c{k}"}'), ("entity", "not json {k}"), (" Decision", '{"title": 1.5}'), ("context", '{"key": "k{k}", "title": "[x", "content": "{y"}'),
]
_PICKED = ", ".join("'" + p.replace("'", "''") + "'" for _, p in _PAYLOADS)
_KINDS = ", ".join(f"'{k}'" for k, _ in _PAYLOADS)


def _plain_sql(names: tuple[str, ...], default: str | None) -> str:
    one = "CASE WHEN json_type(p, '$.{n}') IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') THEN json_extract_string(p, '$.{n}') END"
    return f"coalesce({', '.join(one.format(n=n) for n in names)}, {'NULL' if default is None else repr(default)})"


def _promoted_sql() -> str:
    rows = f"""c AS (SELECT o_orderkey AS id, lower(trim([{_KINDS}][o_orderkey % {len(_PAYLOADS)} + 1])) AS kind, replace([{_PICKED}][o_orderkey % {len(_PAYLOADS)} + 1], '{{k}}', o_orderkey::VARCHAR) AS raw FROM orders),
      j AS (SELECT id, kind, CASE WHEN json_valid(raw) THEN raw::JSON END AS p FROM c)"""
    parts = []
    for kind, fields in promote.FIELDS.items():
        lacks = " ".join(f"WHEN trim(coalesce({f}, '')) = '' THEN 'candidate payload missing required field: {'|'.join(fields[f][0])}'" for f in promote.REQUIRED[kind])
        id_ = "key" if "key" in fields else f"substring(sha256('{kind}' || chr(31) || id), 1, 26)"
        shown = " || ';' || ".join(f"coalesce({f}, '-')" for f in fields)
        inner = ", ".join(f"{_plain_sql(*how)} AS {f}" for f, how in fields.items())
        parts.append(f"SELECT id AS candidate_id, '{kind}' AS record_type, {id_} AS rid, {shown} AS shown, CASE {lacks} END AS error FROM (SELECT id, {inner} FROM j WHERE kind = '{kind}')")
    return f"WITH {rows}, r AS ({' UNION ALL '.join(parts)} UNION ALL SELECT id, kind, NULL, NULL, 'invalid record type: ' || kind FROM j WHERE kind NOT IN ({', '.join(repr(k) for k in promote.FIELDS)}))"


def _promoted(spark, sf_dir):
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (C("o_orderkey") % len(_PAYLOADS) + 1).cast("int"))
    o = table(spark, sf_dir, "orders")
    payload = F.replace(at([p for _, p in _PAYLOADS]), F.lit("{k}"), C("o_orderkey").cast("string"))
    candidates = o.select(C("o_orderkey").alias("id"), at([k for k, _ in _PAYLOADS]).alias("record_type"), F.lit("").alias("scope"), payload.alias("payload"))
    evidence = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), C("l_orderkey").alias("candidate_id"))
    return promote.promote(candidates, evidence)


@register("c5_promotion", _promoted_sql() + " SELECT candidate_id, CASE WHEN error IS NULL THEN record_type END AS record_type, CASE WHEN error IS NULL THEN rid END AS id, CASE WHEN error IS NULL THEN shown END AS shown, error FROM r")
def c5(spark, sf_dir):
    """Candidates made of the orders, by record type, with those that fail."""
    done = _promoted(spark, sf_dir)
    shown = lambda kind: F.concat_ws(";", *[F.coalesce(f, F.lit("-")) for f in promote.FIELDS[kind]])
    out = done.failed.select(C("id").alias("candidate_id"), *[F.lit(None).cast("string").alias(c) for c in ("record_type", "id", "shown")], "error")
    for kind, rows in done.tables.items():
        out = out.unionByName(rows.select("candidate_id", F.lit(kind).alias("record_type"), "id", shown(kind).alias("shown"), F.lit(None).cast("string").alias("error")))
    return out


@register("c5_promoted_evidence", _promoted_sql() + " SELECT concat_ws('-', l_orderkey, l_linenumber) AS id, CASE WHEN error IS NULL THEN record_type END AS trusted_record_type, CASE WHEN error IS NULL THEN rid END AS trusted_record_id FROM lineitem LEFT JOIN r ON candidate_id = l_orderkey")
def c5_evidence(spark, sf_dir):
    return _promoted(spark, sf_dir).evidence.select("id", "trusted_record_type", "trusted_record_id")


# embedding


@register("r14_rebuild", """WITH j AS (SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' WHEN 2 THEN 'embedded' ELSE 'failed' END AS status, source AS scope, doc_id % 3 AS attempts, text FROM documents),
  a AS (SELECT *, CASE WHEN status = 'pending' OR status = 'failed' AND length(coalesce(scope, '')) % 2 = 0 AND scope IS NOT NULL THEN 1 ELSE 0 END AS again FROM j)
  SELECT id, CASE WHEN again = 0 THEN status WHEN text IS NULL OR id % 6 = 5 OR id % 10 = 0 THEN 'skipped' ELSE 'embedded' END AS status, attempts + again AS attempts,
    CASE WHEN again = 0 THEN CASE WHEN status = 'failed' THEN 'no model' END WHEN id % 6 = 5 OR text IS NULL THEN 'record no longer exists' WHEN id % 10 = 0 THEN 'record content changed' END AS error FROM a""")
def r14(spark, sf_dir):
    """Failed jobs of some scopes come back, a round of work settles them, in one state of the queue."""
    d = table(spark, sf_dir, "documents")
    hash_ = F.sha2(F.trim(F.concat("text", F.when(C("doc_id") % 10 == 0, "x").otherwise(""))), 256)
    jobs = d.select(C("doc_id").alias("id"), F.lit("observation").alias("record_type"), C("doc_id").cast("string").alias("record_id"), hash_.alias("content_hash"), C("source").alias("scope"),
        F.element_at(F.array(*map(F.lit, ("failed", "pending", "embedded", "failed"))), (C("doc_id") % 4 + 1).cast("int")).alias("status"), (C("doc_id") % 3).alias("attempts"))
    jobs = jobs.withColumn("error", F.when(C("status") == "failed", "no model"))
    scopes = d.where("source IS NOT NULL").select(C("source").alias("scope")).distinct().where(F.length("scope") % 2 == 0)
    queue = embed.requeue_failed(jobs, scopes)
    records = d.where("text IS NOT NULL AND doc_id % 6 <> 5").select(F.lit("observation").alias("record_type"), C("doc_id").cast("string").alias("record_id"), C("source").alias("scope"), C("text").alias("content"))
    outcomes = embed.work(queue.where("status = 'pending'").drop("scope", "error"), records).select("id", "outcome", "error")
    return embed.settle(queue, outcomes).select("id", "status", "attempts", "error")


@register("b5_live_vectors", f"WITH {mapping.OBSERVATIONS_SQL} SELECT v.vec_id AS id, label FROM embeddings v LEFT JOIN observations o ON o.id = v.vec_id WHERE v.vec_id % 3 = 0 OR (o.id IS NOT NULL AND o.valid_to IS NULL)")
def b5_vectors(spark, sf_dir):
    """Vectors of closed facts are gone; those of other record types (every third) stay."""
    v = table(spark, sf_dir, "embeddings").select(F.when(C("vec_id") % 3 == 0, "decision").otherwise("observation").alias("record_type"), C("vec_id").cast("string").alias("record_id"), "label", C("vec_id").alias("id"))
    return embed.drop_closed(v, mapping.observations(spark, sf_dir)).select("id", "label")


# bundles


@register("s10_parent_chain", """WITH RECURSIVE o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 3 THEN -1 ELSE lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS parent FROM orders),
  ok AS (SELECT id FROM o WHERE id % 5 = 0 OR parent IS NULL UNION SELECT o.id FROM o JOIN ok ON o.parent = ok.id)
  SELECT CASE WHEN parent IS NOT NULL AND parent NOT IN (SELECT id FROM ok) THEN 'orphan' WHEN id % 5 = 0 THEN 'kept' ELSE 'inserted' END AS outcome, count(*) AS n FROM o GROUP BY 1""")
def s10(spark, sf_dir):
    """Each order's parent is the one before it of its customer, some are lost; every fifth order is there already."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), F.when(C("o_orderkey") % 11 == 3, -1).otherwise(before).alias("parent"))
    rules = {"sessions": assist.Merge("id", "keep", None, (("parent", "sessions"),))}
    return assist.merge_bundle({"sessions": rows.where("id % 5 = 0")}, {"sessions": rows}, rules)[1].select("outcome", "n")


_SNAPSHOT = f"""WITH {mapping.ENTITIES_SQL}, {mapping.RELATIONS_SQL}, e AS (SELECT * FROM entities WHERE scope IN ('nation/3', 'nation/7', 'parts')), r AS (SELECT * FROM relations WHERE src IN (SELECT id FROM e) AND dst IN (SELECT id FROM e)),
  s AS (SELECT id FROM e WHERE entity_type = 'supplier')"""


@register("s11_scoped_snapshot", f"{_SNAPSHOT} SELECT 'entities' AS \"table\", count(*) AS n FROM e UNION ALL SELECT 'relations', count(*) FROM r UNION ALL SELECT 'state', count(*) FROM (SELECT 's' || s_suppkey AS entity FROM supplier WHERE s_acctbal > 0) WHERE entity IN (SELECT id FROM s)")
def s11(spark, sf_dir):
    """Rows of three tables in some scopes: entities by their own, relations by both ends, live accounts by their supplier."""
    state = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity"), C("s_acctbal").alias("balance"), C("s_suppkey").alias("id"))
    tables = {
        "entities": assist.Live(mapping.entities(spark, sf_dir)),
        "relations": assist.Live(mapping.relations(spark, sf_dir), None, ("src", "dst"), (("src", "entities"), ("dst", "entities"))),
        "state": assist.Live(state, C("balance") > 0, ("id",), (("entity", "entities"),)),
    }
    scopes = mapping.entities(spark, sf_dir).select("scope").distinct().where(C("scope").isin("nation/3", "nation/7", "parts"))
    out = None
    for name, (rows, _) in assist.snapshot(tables, scopes).items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# graph


@register("g12_crossing_edges", f"""WITH {mapping.ENTITIES_SQL}, {mapping.RELATIONS_SQL}, m AS (SELECT id, entity_type AS kind, CASE WHEN entity_type = 'supplier' THEN scope ELSE 'nation/' || (CAST(id[2:] AS BIGINT) % 25) END AS community FROM entities)
  SELECT src, dst, round(2 * weight * CASE WHEN a.kind <> b.kind THEN 1.5 ELSE 1 END * CASE WHEN weight > 1 THEN 1 ELSE 0.5 END, 6)::DOUBLE AS score FROM relations JOIN m a ON a.id = src JOIN m b ON b.id = dst WHERE a.community <> b.community""")
def g12(spark, sf_dir):
    """Suppliers in the communities of their nations and parts dealt over them; edges of one line aren't certain."""
    e = mapping.entities(spark, sf_dir)
    own = F.when(C("entity_type") == "supplier", C("scope")).otherwise(F.concat(F.lit("nation/"), (F.substring("id", 2, 20).cast("long") % 25).cast("string")))
    return graph.crossing(mapping.relations(spark, sf_dir).withColumn("certain", C("weight") > 1), e.select("id", own.alias("community"), C("entity_type").alias("kind")))


@register("g2_pagerank_push")
def g2_push(spark, sf_dir):
    """The ten first nodes around the suppliers of each nation, by pushing; a test holds them against g2_pagerank_all."""
    seeds = mapping.entities(spark, sf_dir).where("entity_type = 'supplier'").select(C("scope").alias("qid"), "id", F.lit(1.0).alias("weight"))
    found = graph.pagerank_push(seeds, mapping.relations(spark, sf_dir)).select("qid", "id", F.round("score", 5).alias("score"))
    return top(found, ["qid"], [C("score").desc(), C("id")], 10)


# transcripts


@register("d5_transcript_function", r"""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, role, CASE WHEN conv_id % 2 = 0 THEN 'message' WHEN role = 'user' THEN 'user_message' ELSE 'agent_message' END AS kind,
  regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, turn::VARCHAR AS ts FROM (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 1 AND role <> 'user' THEN 'assistant' ELSE role END AS role, text FROM conversations)""")
def d5(spark, sf_dir):
    """Conversations written as files of two agents' shapes and read back by the table function."""
    transcript_table.register(spark)
    c = table(spark, sf_dir, "conversations")
    ts = C("turn").cast("string").alias("timestamp")
    claude = F.to_json(F.struct(F.lit("message").alias("type"), F.struct("role", F.array(F.struct(F.lit("text").alias("type"), "text")).alias("content")).alias("message"), ts))
    kind = F.when(C("role") == "user", "user_message").otherwise("agent_message")
    codex = F.to_json(F.struct(F.lit("event_msg").alias("type"), F.struct(kind.alias("type"), C("text").alias("message")).alias("payload"), ts))
    lines = c.select("conv_id", "turn", F.when(C("conv_id") % 2 == 0, claude).otherwise(codex).alias("line"))
    files = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("raw"))
    files = files.withColumn("agent", F.when(C("conv_id") % 2 == 0, "claude").otherwise("codex"))
    found = spark.sql("SELECT conv_id, CAST(p.ts AS BIGINT) AS turn, p.* FROM {files} f, LATERAL parse_transcript(f.agent, f.raw) p", files=files)
    return found.select("conv_id", "turn", C("idx").cast("long").alias("idx"), "role", "kind", "text", "ts")
