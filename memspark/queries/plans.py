"""Queries of composed plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.operators import communities, graph
from memspark.operators.stored import stored
from memspark.plans import assist, mapping
from memspark.queries import graphs, retrieval
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


def _queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(C("item_id").alias("qid"), C("text").alias("query"))


def _records(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(C("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), C("text").alias("content"))


def _nodes(spark, sf_dir):
    return mapping.entities(spark, sf_dir).withColumn("name", C("id"))


_NOTE = "no semantic result: keyword order"


@register("r8_hybrid_search", f"SELECT qid, id, score, rank, CASE WHEN qid NOT IN (SELECT qid FROM ({retrieval.semantic_sql(30)})) THEN '{_NOTE}' END AS fallback FROM ({retrieval.fused_sql(30, 10, True)})")
def r8(spark, sf_dir):
    return assist.find(_queries(spark, sf_dir), _records(spark, sf_dir))


@register("r6_rerank", f"""WITH p AS ({retrieval.keyword_sql(30)}), {retrieval.BOOSTS_SQL}
  SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM (SELECT qid, id, round(1 / (1 + exp(-boost)), 6) AS score FROM boosts) QUALIFY rank <= 10""")
def r6(spark, sf_dir):
    q, r = _queries(spark, sf_dir), _records(spark, sf_dir)
    return assist.rerank(assist.find(q, r, "keyword", 30), q, r)


@register("r9_ask", f"""SELECT item_id AS qid, coalesce('Known:' || chr(10) || lines, 'Nothing is known about this.') AS answer FROM benchmark LEFT JOIN (
  SELECT qid, string_agg('[' || rank || '] ' || split_part(text, chr(10), 1) || ' (' || id || ')', chr(10) ORDER BY rank) AS lines FROM ({retrieval.fused_sql(15, 5, True)}) JOIN documents ON doc_id = id GROUP BY qid) ON qid = item_id""")
def r9(spark, sf_dir):
    return assist.ask(_queries(spark, sf_dir), _records(spark, sf_dir))[0]


@register("r11_handoff", """WITH d AS (SELECT l_orderkey AS id, l_returnflag || '/' || l_partkey || '/' || l_linenumber AS title, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_returnflag || '/' || l_partkey || '/' || l_linenumber) AS n FROM lineitem),
  a AS (SELECT id, string_agg('- ' || title, chr(10) ORDER BY n) AS d FROM d WHERE n <= 10 GROUP BY id), s AS (SELECT n_regionkey % 3 AS k, string_agg('- ' || n_name, chr(10) ORDER BY '- ' || n_name) AS s FROM nation GROUP BY 1)
  SELECT o_orderkey AS id, 'Goal: ' || o_orderpriority || chr(10) || 'Decisions:' || chr(10) || coalesce(d, '- none') || chr(10) || 'State:' || chr(10) || coalesce(s, '- none') AS context FROM orders LEFT JOIN a ON id = o_orderkey LEFT JOIN s ON k = o_orderkey % 3""")
def r11(spark, sf_dir):
    sessions = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), C("o_orderpriority").alias("goal"), (C("o_orderkey") % 3).cast("string").alias("scope"))
    title = F.concat_ws("/", "l_returnflag", C("l_partkey").cast("string"), C("l_linenumber").cast("string"))
    decisions = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("decided_in"), title.alias("title"), C("l_shipdate").alias("created_at"))
    state = table(spark, sf_dir, "nation").select((C("n_regionkey") % 3).cast("string").alias("scope"), C("n_name").alias("title"))
    return assist.handoffs(sessions, decisions, state)


@register("r9_scoped_answers", f"""WITH q AS (SELECT item_id AS qid, trim(text) AS query, 'r/' || (item_id % 5) AS scope FROM benchmark),
  t AS (SELECT 'r/' || (s_suppkey % 5) AS scope, 's' || s_suppkey AS key, s_suppkey % 7 AS u FROM supplier UNION ALL SELECT '', 'n' || n_nationkey, n_nationkey % 7 FROM nation),
  v AS (SELECT q.scope, key, row_number() OVER (PARTITION BY q.scope ORDER BY u DESC, key) AS n FROM (SELECT DISTINCT scope FROM q) q JOIN t ON t.scope IN ('', q.scope)),
  sd AS (SELECT scope, 'Active work: ' || string_agg(key, '; ' ORDER BY n) || '.' AS state FROM v WHERE n <= 3 GROUP BY scope),
  p AS (SELECT 'r/' || (o_custkey % 5) AS scope, 'Pending review: ' || least(count(*), 200) || '.' AS pending FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
  e AS (SELECT doc_id AS id, string_agg('label/' || toxic, ', ') AS proof FROM labels GROUP BY doc_id),
  f AS (SELECT qid, 'Most relevant:' || chr(10) || string_agg('- [document] ' || split_part(text, chr(10), 1) || ' (global) — ' || source || ' Evidence: ' || coalesce(proof, 'no evidence link'), chr(10) ORDER BY rank) AS cited
    FROM ({retrieval.fused_sql(15, 5, True)}) r JOIN documents ON doc_id = r.id LEFT JOIN e ON e.id = r.id GROUP BY qid)
  SELECT qid, concat_ws(chr(10), 'Asked: ' || query, CASE WHEN state IS NULL AND cited IS NULL THEN 'Nothing is known about this.' END, state, cited, pending) AS answer FROM q LEFT JOIN sd USING (scope) LEFT JOIN p USING (scope) LEFT JOIN f USING (qid)""")
def r9s(spark, sf_dir):
    """The benchmark's questions from five scopes; suppliers and nations are the open work, orders the candidates, labels the evidence."""
    r, region = _records(spark, sf_dir), lambda c: F.concat(F.lit("r/"), (C(c) % 5).cast("string"))
    questions = table(spark, sf_dir, "benchmark").select(C("item_id").alias("qid"), C("text").alias("query"), region("item_id").alias("scope"), F.lit("codex").alias("agent"))
    documents = table(spark, sf_dir, "documents").select(C("doc_id").alias("id"), F.lit("document").alias("record_type"), F.lit("").alias("scope"), C("source").alias("snippet"))
    found = stored(assist.find(_queries(spark, sf_dir), r, "hybrid", 5).select("qid", "id", "rank"), "found")
    found = found.join(assist.named(documents, found), "id").join(assist.named(r.select("id", "title"), found), "id")
    work = lambda name, scope, mark, key: table(spark, sf_dir, name).select(scope.alias("scope"), F.concat(F.lit(mark), C(key).cast("string")).alias("key"), (C(key) % 7).alias("at"))
    state = work("supplier", region("s_suppkey"), "s", "s_suppkey").unionByName(work("nation", F.lit(""), "n", "n_nationkey"))
    candidates = table(spark, sf_dir, "orders").select(region("o_custkey").alias("scope"), F.when(C("o_orderstatus") == "P", "pending").otherwise("approved").alias("status"))
    evidence = table(spark, sf_dir, "labels").select(C("doc_id").alias("id"), C("quality").alias("created_at"), F.concat(F.lit("label/"), C("toxic").cast("string")).alias("uri"))
    return assist.scoped_answers(questions, found, {"Active work": (state, C("key"), [C("at").desc(), C("key")], 3)}, candidates, evidence)["answers"]


def _line(parts: str) -> str:
    """SQL of a text whose parts are joined; ~ stands for a line feed."""
    return parts.replace("~", "' || chr(10) || '")


_HANDOFF_SQL = _line("""WITH s AS (SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS project, 'r/' || (o_custkey % 5) AS scope, o_orderpriority AS goal, o_orderstatus AS st, o_orderkey % 3 = 0 AS has, o_orderdate AS d FROM orders),
  l AS (SELECT project, id FROM s WHERE st = 'O' QUALIFY row_number() OVER (PARTITION BY project ORDER BY d DESC, id DESC) = 1),
  w AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 1 THEN c_custkey::VARCHAR ELSE l.id END AS id FROM customer LEFT JOIN l ON project = c_custkey::VARCHAR), p AS (SELECT * FROM s JOIN w USING (id) WHERE st = 'O'),
  m AS (SELECT l_orderkey::VARCHAR AS id, l_linenumber || ': ' || l_returnflag AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber::VARCHAR DESC) AS n FROM lineitem),
  md AS (SELECT id, string_agg('- ' || line, chr(10) ORDER BY n) AS made FROM m WHERE n <= 3 GROUP BY id),
  t AS (SELECT 'r/' || (s_suppkey % 5) AS scope, 's' || s_suppkey AS key, s_suppkey % 7 AS u, s_nationkey AS k FROM supplier UNION ALL SELECT '', 'n' || n_nationkey, n_nationkey % 7, n_nationkey FROM nation),
  v AS (SELECT q.scope, key || ': ' || k || ' [blocked]' AS line, row_number() OVER (PARTITION BY q.scope ORDER BY u DESC, key) AS n FROM (SELECT DISTINCT scope FROM p) q JOIN t ON t.scope IN ('', q.scope)),
  sd AS (SELECT scope, string_agg('- ' || line, chr(10) ORDER BY n) AS state FROM v WHERE n <= 3 GROUP BY scope)
  SELECT id, substr(sha256('handoff' || chr(31) || id), 1, 26) AS child_session, '# Handoff~~- Parent session: ' || id || '~- Tool: codex~- Project: ' || project || '~- Scope: ' || scope || '~- Goal: ' || goal || '~~## Summary~'
   || CASE WHEN has THEN 'done' ELSE '- None recorded.' END || '~~## Accomplishments~' || CASE WHEN has THEN '- ' || goal || '~- two' ELSE '- None recorded.' END || '~~## Remaining~- None recorded.~~## Files Changed~- None recorded.~~## Decisions Made~'
   || coalesce(made, '- None recorded.') || '~~## Relevant Active Work~' || coalesce(state, '- None recorded.') || '~~Start from the remaining items and verify current repository state before editing.~' AS context
  FROM p LEFT JOIN md USING (id) LEFT JOIN sd USING (scope)""")


@register("r11_handoff_chain", _HANDOFF_SQL)
def r11c(spark, sf_dir):
    """Each customer hands off: those with an odd number the order of that number, the others the latest open order of their own."""
    orders, at = table(spark, sf_dir, "orders"), F.lit("2025-01-01 00:00:00").cast("timestamp")
    status = F.when(C("o_orderstatus") == "O", "active").otherwise("completed")
    none, has = F.lit(None), C("o_orderkey") % 3 == 0
    sessions = orders.select(
        C("o_orderkey").cast("string").alias("id"), F.lit("codex").alias("session_type"), C("o_custkey").cast("string").alias("project"), F.concat(F.lit("r/"), (C("o_custkey") % 5).cast("string")).alias("scope"),
        C("o_orderpriority").alias("goal"), status.alias("status"), none.cast("string").alias("parent_session"), none.cast("string").alias("child_session"), none.cast("string").alias("handoff_context"),
        C("o_orderdate").cast("timestamp").alias("started_at"), none.cast("timestamp").alias("ended_at"), F.when(has, " done ").alias("summary"), F.when(has, F.array("o_orderpriority", F.lit("two"))).alias("accomplishments"),
        F.array().cast("array<string>").alias("remaining"), none.cast("array<string>").alias("files_changed"),
    )
    customer = C("c_custkey").cast("string")
    asked = table(spark, sf_dir, "customer").select(C("c_custkey").alias("place"), customer.alias("project"), F.when(C("c_custkey") % 2 == 1, customer).alias("id"))
    decisions = table(spark, sf_dir, "lineitem").select(C("l_linenumber").cast("string").alias("id"), C("l_orderkey").cast("string").alias("decided_in"), C("l_returnflag").alias("title"), C("l_shipdate").alias("created_at"))
    work = lambda name, scope, mark, key, place: table(spark, sf_dir, name).select(scope.alias("scope"), F.concat(F.lit(mark), C(key).cast("string")).alias("key"), C(place).cast("string").alias("title"), F.lit("blocked").alias("status"), (C(key) % 7).alias("updated_at"))
    state = work("supplier", F.concat(F.lit("r/"), (C("s_suppkey") % 5).cast("string")), "s", "s_suppkey", "s_nationkey").unionByName(work("nation", F.lit(""), "n", "n_nationkey", "n_nationkey"))
    return assist.hand_off(sessions, asked, decisions, state, at, 3)["contexts"]


@register("w9_session_lineage", "SELECT event_id AS id, event_id - (event_id % 64) AS root, event_id % 64 AS depth FROM events")
def w9(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(C("event_id").alias("id"), F.when(C("event_id") % 64 > 0, C("event_id") - 1).alias("parent_session"))
    return assist.lineage(e)


@register("s10_import_kept", f"WITH {mapping.RELATIONS_SQL} SELECT src, dst, weight FROM relations WHERE substr(dst, 2)::BIGINT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def s10(spark, sf_dir):
    parents = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return assist.import_children(mapping.relations(spark, sf_dir), parents, "dst")[0].select("src", "dst", "weight")


@register("s10_import_orphans", f"WITH {mapping.RELATIONS_SQL} SELECT src, dst, weight FROM relations WHERE substr(dst, 2)::BIGINT NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def s10o(spark, sf_dir):
    parents = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), "p_partkey").alias("id"))
    return assist.import_children(mapping.relations(spark, sf_dir), parents, "dst")[1].select("src", "dst", "weight")


@register("g4_communities")
def g4(spark, sf_dir):
    return communities.louvain(_nodes(spark, sf_dir), mapping.relations(spark, sf_dir))


@register("f26_theme_labels", f"""{graphs.COMPONENTS_SQL}, n AS (SELECT c AS community, id AS name, row_number() OVER w AS i, sum(length(id) + 2) OVER (PARTITION BY c ORDER BY id ROWS UNBOUNDED PRECEDING) - 2 AS n, count(*) OVER (PARTITION BY c) AS k FROM l10 WINDOW w AS (PARTITION BY c ORDER BY id))
  SELECT community, string_agg(name, ', ' ORDER BY name) || CASE WHEN count(*) < any_value(k) THEN '…' ELSE '' END AS label FROM n WHERE i = 1 OR n <= 80 GROUP BY community""")
def f26(spark, sf_dir):
    parts = graph.components(_nodes(spark, sf_dir), mapping.relations(spark, sf_dir))
    return communities.theme_labels(parts.select("id", C("id").alias("name"), C("component").alias("community")))


@register("g9_reflection")
def g9(spark, sf_dir):
    """Communities of the supplier-part graph; documents are the observations of the supplier that their number names."""
    n = table(spark, sf_dir, "supplier").count()
    docs = mapping.observations(spark, sf_dir).where("valid_to IS NULL")
    observed = docs.select(C("id"), F.concat(F.lit("s"), (C("id") % n + 1).cast("string")).alias("entity_id"), "content", "category", "confidence", F.lit(1.0).alias("salience"))
    return communities.reflect(_nodes(spark, sf_dir), mapping.relations(spark, sf_dir), observed)
