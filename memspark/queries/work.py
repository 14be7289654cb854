"""Queries of write commands, capture, embedding work, details, datasets and comparisons of modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import enums
from memspark.operators import capture, commands, detail, embed, evaluate, evidence, listing, search
from memspark.operators.stored import stored
from memspark.plans import assist, mapping
from memspark.plans.lift import reflection_lift
from memspark.sources import datasets
from memspark.streaming.workers import changed_files, tail
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


def _at():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


def _pick(values: list[str], n):
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def _sql_pick(values: list[str], n: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][({n}) % {len(values)} + 1]"


# enums

_STATE = ["planned", "done", "nowhere", "blocked", ""]


@register("p4_quarantined", f"""SELECT * FROM (SELECT o_orderkey AS id, array_to_string(list_filter([CASE WHEN {_sql_pick(_STATE, 'o_custkey')} NOT IN ('planned', 'in-progress', 'blocked', 'needs-review', 'done', 'abandoned') THEN 'status' END,
  CASE WHEN lower(o_orderpriority[3:]) NOT IN ('critical', 'high', 'medium', 'low') THEN 'priority' END, CASE WHEN NOT o_totalprice / 400000 BETWEEN 0 AND 1 THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS errors FROM orders) WHERE errors <> ''""")
def p4(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), _pick(_STATE, C("o_custkey")).alias("status"), F.lower(F.expr("substring(o_orderpriority, 3)")).alias("priority"), (C("o_totalprice") / 400000).alias("confidence"))
    _, wrong = enums.split_valid(rows, {"status": enums.STATE_STATUS, "priority": enums.STATE_PRIORITY, "confidence": enums.in_unit(C("confidence"))})
    return wrong.select("id", F.array_join("errors", ",").alias("errors"))


# candidates

_KINDS, _SCOPES, _PAYLOADS = [" Entity", "observation", "theme", "STATE", "decision"], ["", "a/b", "a//b", "team.one"], ["props", "broken", "props", "list", "props", "props", "secret"]


def _proposals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = _pick(_PAYLOADS, C("event_id"))
    secret = F.concat(F.lit('{"api_key":"x'), C("event_id").cast("string"), F.lit('","n":"ok"}'))
    payload = F.when(kind == "props", C("props")).when(kind == "broken", F.lit("{no")).when(kind == "list", F.lit("[1]")).otherwise(secret)
    return e.select(
        C("event_id").alias("id"), F.when(C("event_id") % 9 == 0, " ").otherwise(C("event_type")).alias("source_type"), C("user_id").cast("string").alias("source"), _pick(_KINDS, C("event_id")).alias("record_type"),
        payload.alias("payload"), _pick(_SCOPES, C("event_id")).alias("scope"), (C("value") / 200).alias("confidence"), F.lit("seen in the log").alias("rationale"),
    )


_PROPOSALS_SQL = f"""p AS (SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN '' ELSE event_type END AS source_type, lower(trim({_sql_pick(_KINDS, 'event_id')})) AS record_type, {_sql_pick(_PAYLOADS, 'event_id')} AS kind,
  {_sql_pick(_SCOPES, 'event_id')} AS scope, value / 200 AS confidence, props FROM events),
  q AS (SELECT *, array_to_string(list_filter([CASE WHEN record_type = 'theme' THEN 'record_type' END, CASE WHEN source_type = '' THEN 'source_type' END, CASE WHEN scope = 'a//b' THEN 'scope' END,
    CASE WHEN NOT confidence BETWEEN 0 AND 1 THEN 'confidence' END, CASE WHEN kind IN ('broken', 'list') THEN 'payload' END], lambda x: x IS NOT NULL), ',') AS errors FROM p)"""


@register("c1_proposed", f"""WITH {_PROPOSALS_SQL} SELECT id, source_type, record_type, scope, CASE kind WHEN 'secret' THEN '{{"api_key":"[REDACTED_SECRET]","n":"ok"}}' ELSE json(props)::VARCHAR END AS payload, confidence, 'pending' AS status FROM q WHERE errors = ''""")
def c1(spark, sf_dir):
    return commands.propose(_proposals(spark, sf_dir))[0].select("id", "source_type", "record_type", "scope", "payload", "confidence", "status")


@register("c1_quarantined", f"WITH {_PROPOSALS_SQL} SELECT id, errors FROM q WHERE errors <> ''")
def c1q(spark, sf_dir):
    return commands.propose(_proposals(spark, sf_dir))[2].select("id", F.array_join("errors", ",").alias("errors"))


@register("c1_evidence", f"""WITH {_PROPOSALS_SQL} SELECT d.doc_id AS candidate_id, CASE WHEN length(o) > 800 THEN rtrim(o[1:797]) || '...' ELSE o END AS excerpt
  FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS o FROM documents) d JOIN q ON q.id = d.doc_id AND errors = ''""")
def c1e(spark, sf_dir):
    evidence = table(spark, sf_dir, "documents").select(C("doc_id").alias("candidate_id"), C("text").alias("excerpt"))
    return commands.propose(_proposals(spark, sf_dir), evidence)[1]


def _edits(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(
        C("o_orderkey").alias("id"), F.when(C("o_orderstatus") == "F", "approved").otherwise("pending").alias("status"), F.lit("context").alias("record_type"), F.lit("{}").alias("payload"), F.lit("").alias("scope"), F.lit(0.5).alias("confidence"), C("o_orderpriority").alias("rationale")
    )
    n = C("l_orderkey") + C("l_linenumber")
    edits = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3").select(
        C("l_orderkey").alias("id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("place"), F.when(n % 3 == 0, "State").when(n % 17 == 0, "theme").alias("record_type"), F.lit(None).cast("string").alias("payload"),
        F.when(n % 4 == 0, "a/b").when(n % 19 == 0, "/").alias("scope"), F.when(n % 2 == 0, C("l_discount") * 10).alias("confidence"), F.lit(None).cast("string").alias("rationale"),
    )
    return commands.edit(base, edits)


_EDITS_SQL = """b AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'approved' ELSE 'pending' END AS status, o_orderpriority AS rationale FROM orders),
  e AS (SELECT l_orderkey AS id, (l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS place, l_linenumber, l_partkey, l_orderkey + l_linenumber AS n, l_discount * 10 AS d FROM lineitem WHERE l_linenumber <= 3),
  f AS (SELECT e.*, CASE WHEN n % 3 = 0 THEN 'state' WHEN n % 17 = 0 THEN 'theme' END AS rt, CASE WHEN n % 4 = 0 THEN 'a/b' WHEN n % 19 = 0 THEN '/' END AS sc, CASE WHEN n % 2 = 0 THEN d END AS cf, status FROM e LEFT JOIN b USING (id)),
  g AS (SELECT *, CASE WHEN status IS NULL THEN 'not found' WHEN status <> 'pending' THEN 'already ' || status WHEN rt = 'theme' THEN 'record_type' WHEN sc = '/' THEN 'scope' WHEN NOT cf BETWEEN 0 AND 1 THEN 'confidence' END AS error FROM f)"""


@register("c4_edited", f"""WITH {_EDITS_SQL}, h AS (SELECT id, arg_max(rt, place) FILTER (rt IS NOT NULL) AS rt, arg_max(sc, place) FILTER (sc IS NOT NULL) AS sc, arg_max(cf, place) FILTER (cf IS NOT NULL) AS cf FROM g WHERE error IS NULL GROUP BY id)
  SELECT id, status, coalesce(rt, 'context') AS record_type, coalesce(sc, '') AS scope, round(coalesce(cf, 0.5), 6) AS confidence, rationale FROM b LEFT JOIN h USING (id)""")
def c4(spark, sf_dir):
    return _edits(spark, sf_dir)[0].select("id", "status", "record_type", "scope", F.round("confidence", 6).alias("confidence"), "rationale")


@register("c4_failed", f"WITH {_EDITS_SQL} SELECT id, l_linenumber AS line, l_partkey AS part, error FROM g WHERE error IS NOT NULL")
def c4f(spark, sf_dir):
    return _edits(spark, sf_dir)[1].select("id", C("place.l_linenumber").alias("line"), C("place.l_partkey").alias("part"), "error")


# saves

_TYPES = [*enums.ENTITY_TYPE, "planet"]


def _saved(spark, sf_dir):
    entities = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.concat(F.lit("part-"), C("p_partkey").cast("string")).alias("id"), C("p_name").alias("name"), F.lit("concept").alias("entity_type"), F.lit("").alias("scope"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("created_at"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"))
    none = lambda schema: spark.createDataFrame([], schema)
    c = table(spark, sf_dir, "orders").select(
        C("o_orderkey").alias("place"), F.concat(F.lit(" Part "), C("o_custkey").cast("string")).alias("name"), _pick(_TYPES, C("o_orderkey")).alias("entity_type"), F.lit("general").alias("category"), F.when(C("o_orderkey") % 3 == 0, "a/b").otherwise("").alias("scope"),
        F.when(C("o_orderkey") % 2 == 0, F.concat(F.lit(" said in "), C("o_orderkey").cast("string"))).alias("observe"), F.when(C("o_orderkey") % 5 == 0, F.concat(F.lit("Part "), (C("o_orderkey") % 97).cast("string"), F.lit(": uses"))).when(C("o_orderkey") % 7 == 0, F.lit("nowhere")).alias("relate"),
        F.when(C("o_orderkey") % 4 == 0, C("o_orderkey").cast("string")).alias("session"),
    )
    return commands.save_entities(
        entities, none("id string, entity_id string, content string, category string, source string"), none("id string, from_entity string, to_entity string, relation string, source string, valid_to timestamp"), c, _at()
    )


_SAVED_SQL = f"""b AS (SELECT 'part-' || p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 2 = 0),
  k AS (SELECT o_orderkey AS place, 'part-' || o_custkey AS entity_id, 'Part ' || o_custkey AS name, {_sql_pick(_TYPES, 'o_orderkey')} AS entity_type, CASE WHEN o_orderkey % 3 = 0 THEN 'a/b' ELSE '' END AS scope,
    CASE WHEN o_orderkey % 2 = 0 THEN 'said in ' || o_orderkey END AS observe, CASE WHEN o_orderkey % 5 = 0 THEN 'part-' || (o_orderkey % 97) END AS target, o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 AS bad, CASE WHEN o_orderkey % 4 = 0 THEN 'session:' || o_orderkey END AS source FROM orders),
  v AS (SELECT * FROM k WHERE entity_type <> 'planet' AND NOT bad), ids AS (SELECT id FROM b UNION SELECT entity_id FROM v), ok AS (SELECT * FROM v WHERE target IS NULL OR target IN (SELECT id FROM ids))"""


@register("c8_saved_entities", f"""WITH {_SAVED_SQL}, l AS (SELECT entity_id AS id, arg_max(name, place) AS name, arg_max(entity_type, place) AS entity_type, arg_max(scope, place) AS scope FROM ok GROUP BY 1)
  SELECT id, coalesce(l.name, b.name) AS name, coalesce(entity_type, 'concept') AS entity_type, coalesce(scope, '') AS scope, CASE WHEN b.id IS NULL THEN '2025' ELSE '2024' END AS created, CASE WHEN l.id IS NULL THEN '2024' ELSE '2025' END AS updated FROM b FULL JOIN l USING (id)""")
def c8(spark, sf_dir):
    year = lambda c: F.date_format(c, "yyyy")
    return _saved(spark, sf_dir)["entities"].select("id", "name", "entity_type", "scope", year("created_at").alias("created"), year("updated_at").alias("updated"))


@register("c8_saved_observations", f"WITH {_SAVED_SQL} SELECT entity_id, observe AS content, 'general' AS category, source FROM ok WHERE observe IS NOT NULL")
def c8o(spark, sf_dir):
    return _saved(spark, sf_dir)["observations"].select("entity_id", "content", "category", "source")


@register("c8_saved_relations", f"WITH {_SAVED_SQL} SELECT entity_id AS from_entity, target AS to_entity, 'uses' AS relation, arg_max(coalesce(source, ''), place) AS source FROM ok WHERE target IS NOT NULL GROUP BY 1, 2")
def c8r(spark, sf_dir):
    return _saved(spark, sf_dir)["relations"].select("from_entity", "to_entity", "relation", F.coalesce("source", F.lit("")).alias("source"))


@register("c8_saved_events", f"""WITH {_SAVED_SQL}, e AS (SELECT CASE WHEN entity_id IN (SELECT id FROM b) OR row_number() OVER (PARTITION BY entity_id ORDER BY place) > 1 THEN 'entity_updated' ELSE 'entity_created' END AS event_type FROM ok
  UNION ALL SELECT 'observation_added' FROM ok WHERE observe IS NOT NULL UNION ALL SELECT 'relation_created' FROM ok WHERE target IS NOT NULL) SELECT event_type, count(*) AS n FROM e GROUP BY 1""")
def c8e(spark, sf_dir):
    return _saved(spark, sf_dir)["events"].groupBy("event_type").agg(F.countDistinct("id").alias("n"))


@register("c8_rejected", f"WITH {_SAVED_SQL} SELECT place FROM k WHERE place NOT IN (SELECT place FROM ok)")
def c8x(spark, sf_dir):
    return _saved(spark, sf_dir)["rejected"].select("place")


# maintenance of records

_ACTIONS = ["put", "update", "delete", "update", "put", "drop"]


def _maintained(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(
        C("c_custkey").alias("key"), C("c_name").alias("title"), C("c_mktsegment").alias("content"), F.lit("spec").alias("category"), F.lit("").alias("scope"), F.lit(1).alias("version"), F.sha2("c_mktsegment", 256).alias("checksum")
    )
    n = C("o_orderkey")
    c = table(spark, sf_dir, "orders").select(
        F.when(n % 10 == 0, -n).otherwise(C("o_custkey")).alias("key"), n.alias("place"), _pick(_ACTIONS, n).alias("action"), F.when(n % 3 > 0, C("o_orderpriority")).alias("title"), F.when(n % 4 > 0, F.concat(F.lit(" body "), n.cast("string"))).alias("content"),
        F.when(n % 5 == 0, F.lit("guide")).when(n % 23 == 0, F.lit("novel")).alias("category"), F.lit(None).cast("string").alias("scope"),
    )
    return commands.apply_commands(base, c, commands.record_rules("context"), _at())


# the same by a recursive walk over each key's commands
_MAINTAINED_SQL = f"""c AS (SELECT CASE WHEN o_orderkey % 10 = 0 THEN -o_orderkey ELSE o_custkey END AS key, o_orderkey AS place, {_sql_pick(_ACTIONS, 'o_orderkey')} AS action, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS title,
    CASE WHEN o_orderkey % 4 > 0 THEN ' body ' || o_orderkey END AS content, CASE WHEN o_orderkey % 5 = 0 THEN 'guide' WHEN o_orderkey % 23 = 0 THEN 'novel' END AS category FROM orders),
  v AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY place) AS n FROM c WHERE action <> 'drop' AND coalesce(category, 'guide') = 'guide'),
  s(key, n, there, title, content, category, version, accepted) AS (
    SELECT k.key, 0, b.c_custkey IS NOT NULL, c_name, c_mktsegment, CASE WHEN b.c_custkey IS NOT NULL THEN 'spec' END, CASE WHEN b.c_custkey IS NOT NULL THEN 1 ELSE 0 END, false
    FROM (SELECT key FROM v UNION SELECT c_custkey FROM customer) k LEFT JOIN customer b ON b.c_custkey = k.key
    UNION ALL SELECT s.key, v.n, CASE v.action WHEN 'put' THEN true WHEN 'delete' THEN false ELSE there END,
      CASE WHEN v.action = 'put' THEN v.title WHEN v.action = 'update' AND there THEN coalesce(v.title, s.title) ELSE s.title END, CASE WHEN v.action = 'put' THEN v.content WHEN v.action = 'update' AND there THEN coalesce(v.content, s.content) ELSE s.content END,
      CASE WHEN v.action = 'put' THEN v.category WHEN v.action = 'update' AND there THEN coalesce(v.category, s.category) ELSE s.category END, version + CASE WHEN v.action = 'put' OR v.action = 'update' AND there THEN 1 ELSE 0 END, v.action = 'put' OR there
    FROM s JOIN v ON v.key = s.key AND v.n = s.n + 1)"""


@register("c9_context_after", f"""WITH RECURSIVE {_MAINTAINED_SQL} SELECT key, title, content, category, version, sha256(trim(content)) AS checksum FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1) WHERE there""")
def c9(spark, sf_dir):
    return _maintained(spark, sf_dir)["table"].select("key", "title", "content", "category", "version", "checksum")


@register("c9_rejected", f"""WITH RECURSIVE {_MAINTAINED_SQL} SELECT c.key, c.place FROM c LEFT JOIN v USING (key, place) LEFT JOIN s ON s.key = v.key AND s.n = v.n WHERE v.n IS NULL OR NOT accepted""")
def c9x(spark, sf_dir):
    return _maintained(spark, sf_dir)["rejected"].select("key", "place")


@register("c9_events", f"""WITH RECURSIVE {_MAINTAINED_SQL} SELECT 'context_' || CASE WHEN v.action = 'delete' THEN 'deleted' WHEN p.there THEN 'updated' ELSE 'created' END AS event_type, count(*) AS n FROM v JOIN s ON s.key = v.key AND s.n = v.n AND accepted JOIN s p ON p.key = v.key AND p.n = v.n - 1 GROUP BY 1""")
def c9e(spark, sf_dir):
    return _maintained(spark, sf_dir)["events"].groupBy("event_type").agg(F.countDistinct("id").alias("n"))


# capture


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    at = (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=C("turn").cast("int")))
    return t.select((C("conv_id") * 1000 + C("turn")).alias("id"), C("conv_id").alias("capture_session"), F.lit("").alias("scope"), F.when(C("turn") % 3 == 2, "file").otherwise("transcript").alias("source_type"), C("role").alias("title"), "text", at.alias("captured_at"))


_LINE = "CASE WHEN length(o) > 360 THEN rtrim(o[1:357]) || '...' ELSE o END"


@register("c6_capture_summaries", f"""WITH t AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, CASE WHEN turn % 3 = 2 THEN 'file' ELSE 'transcript' END AS st, role, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS o, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, conv_id * 1000 + turn DESC) AS r FROM conversations),
  m AS (SELECT conv_id, sum(n) AS n, string_agg(st || ': ' || n, ', ' ORDER BY st) AS mix FROM (SELECT conv_id, st, count(*) AS n FROM t GROUP BY ALL) GROUP BY 1),
  l AS (SELECT conv_id, string_agg('- [' || st || '] ' || role || ' at ' || strftime(TIMESTAMP '2024-01-01' + turn * INTERVAL 1 MINUTE, '%Y-%m-%dT%H:%M:%SZ') || ': ' || CASE WHEN o = '' THEN 'No event text.' ELSE {_LINE} END, chr(10) ORDER BY r) AS lines, max(id) FILTER (r = 1) AS newest FROM t WHERE r <= 30 GROUP BY 1),
  b AS (SELECT conv_id, newest, 'Automatic coding capture summary.' || chr(10) || 'Captured events summarized: ' || n || chr(10) || 'Source mix: ' || mix || chr(10) || chr(10) || 'Recent captured evidence:' || chr(10) || lines || CASE WHEN n > 30 THEN chr(10) || '- ... ' || (n - 30) || ' more events' ELSE '' END AS body FROM m JOIN l USING (conv_id))
  SELECT conv_id || ':context' AS id, 'context' AS record_type, 0.7::DOUBLE AS confidence, 'capture-summary-' || newest AS key, body FROM b UNION ALL SELECT conv_id || ':state', 'state', 0.64::DOUBLE, 'capture-review-' || newest, body FROM b""")
def c6(spark, sf_dir):
    found = capture.summaries(_turns(spark, sf_dir))[0]
    return found.select("id", "record_type", "confidence", F.get_json_object("payload", "$.key").alias("key"), F.coalesce(F.get_json_object("payload", "$.content"), F.get_json_object("payload", "$.details")).alias("body"))


@register("c7_working_tree", """WITH f AS (SELECT o_custkey AS id, 'src/' || o_orderpriority AS path, min(o_orderkey) AS n FROM orders GROUP BY ALL), g AS (SELECT id, count(*) AS k, string_agg(path, ', ' ORDER BY path) AS p FROM f GROUP BY id),
  b AS (SELECT id, 'Working tree snapshot.' || chr(10) || 'Changed: ' || k || ' (' || p || ')' || chr(10) || 'Staged: 0' || chr(10) || 'Unstaged: ' || k || ' (' || p || ')' || chr(10) || 'Untracked: 0' AS body FROM g)
  SELECT id || ':context' AS id, 'context' AS record_type, 0.72::DOUBLE AS confidence, body FROM b UNION ALL SELECT id || ':state', 'state', 0.66::DOUBLE, body FROM b""")
def c7(spark, sf_dir):
    paths = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("id")).agg(F.array_sort(F.collect_set(F.concat(F.lit("src/"), "o_orderpriority"))).alias("changed"))
    none = F.array().cast("array<string>")
    found = capture.working_tree_candidates(paths.select("id", "changed", none.alias("staged"), C("changed").alias("unstaged"), none.alias("untracked")), F.lit(""))
    return found.select("id", "record_type", "confidence", F.coalesce(F.get_json_object("payload", "$.content"), F.get_json_object("payload", "$.details")).alias("body"))


@register("s8_file_events", """WITH f AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'private/' ELSE 'src/' END || page_id || '.html' AS path, html FROM pages)
  SELECT path AS source, 'File changed: ' || page_id || '.html' AS title, CASE WHEN length(html) > 12000 THEN html[1:12000] || chr(10) || '[truncated]' ELSE html END AS text FROM f WHERE page_id % 5 > 1""")
def s8(spark, sf_dir):
    folder = _pick(["node_modules/", "private/", "src/", "src/", "src/"], C("page_id"))
    files = table(spark, sf_dir, "pages").select(F.concat(folder, C("page_id").cast("string"), F.lit(".html")).alias("path"), C("html").alias("content"))
    return capture.file_events(files, spark.createDataFrame([("private",)], "prefix string"), F.lit("")).select("source", "title", "text")


@register("s14_imported", """WITH f AS (SELECT doc_id, 'docs/' || doc_id || '.md' AS path, text FROM documents WHERE trim(text) <> '')
  SELECT path AS source, 'docs-' || doc_id || '-md' AS key, doc_id || '.md' AS title, 'pending' AS status, CASE WHEN length(o) > 800 THEN rtrim(o[1:797]) || '...' ELSE o END AS excerpt FROM (SELECT *, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS o FROM f) WHERE doc_id % 3 <> 0""")
def s14(spark, sf_dir):
    path = F.concat(F.lit("docs/"), C("doc_id").cast("string"), F.lit(".md"))
    docs = table(spark, sf_dir, "documents")
    known = docs.where("doc_id % 3 = 0").select(F.lit("import").alias("source_type"), path.alias("source"))
    found = capture.import_documents(docs.select(path.alias("path"), C("text").alias("content")), known)
    return found.select("source", F.get_json_object("payload", "$.key").alias("key"), F.get_json_object("payload", "$.title").alias("title"), "status", "excerpt")


@register("st4_events_with_sessions", """WITH s AS (SELECT o_custkey AS id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
  SELECT event_id, coalesce('cap-' || latest, sha256('capture' || chr(31) || 'p' || chr(31) || user_id)[1:26]) AS capture_session FROM events LEFT JOIN s ON s.id = user_id""")
def st4(spark, sf_dir):
    # the zero-padded id keeps the order of numbers among sessions that started at once
    sessions = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), F.lit("p").alias("project"), C("o_custkey").cast("string").alias("scope"), F.when(C("o_orderstatus") == "O", "active").otherwise("ended").alias("status"), C("o_orderdate").alias("started_at"))
    named = capture.attach_sessions(table(spark, sf_dir, "events").select("event_id", F.lit("p").alias("project"), C("user_id").cast("string").alias("scope")), sessions.withColumn("id", F.concat(F.lit("cap-"), F.lpad(C("id").cast("string"), 20, "0"))))
    return named.select("event_id", F.regexp_replace("capture_session", "^cap-0*(?=[0-9])", "cap-").alias("capture_session"))


_IMPORT = """WITH e AS (SELECT conv_id, turn, role, md5(text) AS h, conv_id::VARCHAR AS source FROM conversations), k AS (SELECT DISTINCT md5(text) AS h FROM conversations WHERE conv_id % 7 = 0),
  d AS (SELECT *, h IN (SELECT h FROM k) OR row_number() OVER (PARTITION BY h ORDER BY source, turn) > 1 AS dup FROM e),
  p AS (SELECT source, count(*) AS events, count(*) FILTER (dup) AS duplicates, coalesce(sum(count(*) FILTER (NOT dup)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d GROUP BY source)"""


def _imported(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(C("conv_id").cast("string").alias("source"), C("turn").alias("idx"), F.md5("text").alias("h"), "conv_id")
    return capture.import_events(t, t.where("conv_id % 7 = 0").select("h"), ["h"], 50)


@register("st6_import_outcome", f"{_IMPORT} SELECT source, events, duplicates, greatest(0, least(events - duplicates, 50 - before)) AS imported, CASE WHEN before >= 50 THEN 'budget spent' WHEN events = duplicates THEN 'nothing new' END AS skipped FROM p")
def st6(spark, sf_dir):
    return _imported(spark, sf_dir)[1]


@register("st6_imported_events", f"{_IMPORT} SELECT d.source, turn AS idx, h FROM d JOIN p USING (source) WHERE NOT dup QUALIFY before + row_number() OVER (PARTITION BY d.source ORDER BY turn) <= 50")
def st6e(spark, sf_dir):
    return _imported(spark, sf_dir)[0].select("source", "idx", "h")


@register("st2_changed_files", """SELECT page_id::VARCHAR AS path, max(TIMESTAMP '2024-01-01' + k * INTERVAL 1 DAY) AS modified FROM pages, range(1, 4) r(k) WHERE page_id % k = 0 GROUP BY page_id HAVING max(k) > 1 AND NOT (page_id % 4 = 0 AND max(k) = 2)""")
def st2(spark, sf_dir):
    day = lambda k: F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(days=k)
    p = table(spark, sf_dir, "pages").select("page_id", C("page_id").cast("string").alias("path"))
    files = p.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("page_id % k = 0").select("path", day(C("k")).alias("modified"))
    return changed_files(files, p.where("page_id % 4 = 0").select("path", day(F.lit(2)).alias("modified")), "2024-01-03 00:00:00")


@register("st5_event_tail", "SELECT event_id, event_type FROM events WHERE event_id > 500")
def st5(spark, sf_dir):
    return tail(table(spark, sf_dir, "events"), 500).select("event_id", "event_type")


@register("a15_capture_status", """WITH e AS (SELECT user_id::VARCHAR AS scope, event_id AS id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), s AS (SELECT o_custkey::VARCHAR AS scope, count(*) FILTER (o_orderstatus = 'O') AS a FROM orders GROUP BY 1)
  SELECT c_custkey::VARCHAR AS scope, coalesce(a, 0) AS active_sessions, coalesce(n, 0) AS events, coalesce(recent, '') AS recent FROM customer LEFT JOIN s ON s.scope = c_custkey::VARCHAR
  LEFT JOIN (SELECT scope, count(*) AS n, string_agg(id, ',' ORDER BY r) FILTER (r <= 20) AS recent FROM e GROUP BY scope) x ON x.scope = c_custkey::VARCHAR""")
def a15(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(C("event_id").alias("id"), C("user_id").cast("string").alias("scope"), C("ts").alias("captured_at"))
    sessions = table(spark, sf_dir, "orders").select(C("o_custkey").cast("string").alias("scope"), F.when(C("o_orderstatus") == "O", "active").otherwise("ended").alias("status"))
    return capture.capture_status(table(spark, sf_dir, "customer").select(C("c_custkey").cast("string").alias("scope")), sessions, events)


# embedding work


def _embeddable(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    entities = t("supplier").select(C("s_suppkey").cast("string").alias("id"), C("s_name").alias("name"), F.lit("service").alias("entity_type"), F.concat(F.lit("n/"), C("s_nationkey").cast("string")).alias("scope"))
    n = t("supplier").count()
    observations = t("documents").select(C("doc_id").alias("id"), (C("doc_id") % n).cast("string").alias("entity_id"), C("text").alias("content"), F.when(C("doc_id") % 7 == 0, _at()).alias("valid_to"))
    decisions = t("orders").select(C("o_orderkey").alias("id"), C("o_orderpriority").alias("title"), F.when(C("o_orderstatus") != "P", C("o_orderstatus")).alias("reasoning"), F.lit("").alias("scope"))
    context = t("benchmark").select(C("item_id").alias("key"), F.lit("item").alias("title"), C("text").alias("content"), F.lit("").alias("scope"))
    return embed.embeddable(entities, observations, decisions, context)


_EMBEDDABLE_SQL = """x AS (SELECT 'entity' AS record_type, s_suppkey::VARCHAR AS record_id, 'n/' || s_nationkey AS scope, s_name || ' service' AS content FROM supplier
  UNION ALL SELECT 'observation', doc_id::VARCHAR, 'n/' || s_nationkey, text FROM documents JOIN supplier ON s_suppkey = doc_id % (SELECT count(*) FROM supplier) WHERE doc_id % 7 <> 0
  UNION ALL SELECT 'decision', o_orderkey::VARCHAR, '', o_orderpriority || ' ' || CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END FROM orders UNION ALL SELECT 'context', item_id::VARCHAR, '', 'item ' || text FROM benchmark)"""


@register("r13_embedding_text", f"WITH {_EMBEDDABLE_SQL} SELECT record_type, record_id, scope, md5(content) AS h FROM x")
def r13(spark, sf_dir):
    return _embeddable(spark, sf_dir).select("record_type", "record_id", "scope", F.md5("content").alias("h"))


def _jobs(spark, sf_dir):
    """A job for each record; every third one's hash is stale, and every fifth one's record doesn't exist."""
    r = _embeddable(spark, sf_dir).where("record_type IN ('observation', 'context')")
    n = C("record_id").cast("long")
    return r.select(
        F.concat("record_type", F.lit("-"), "record_id").alias("id"), "record_type", F.when(n % 5 == 0, F.concat(F.lit("gone-"), "record_id")).otherwise(C("record_id")).alias("record_id"), "scope", F.when(n % 3 == 0, "stale").otherwise(F.sha2(F.trim("content"), 256)).alias("content_hash"),
        F.when(n % 2 == 0, "pending").otherwise("embedded").alias("status"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(secs=n.cast("decimal(18,6)") % 100)).alias("created_at"),
    )


@register("s12_pending_jobs", f"""WITH {_EMBEDDABLE_SQL}, j AS (SELECT record_type || '-' || record_id AS id, scope, record_id::BIGINT % 100 AS since FROM x WHERE record_type IN ('observation', 'context') AND record_id::BIGINT % 2 = 0)
  SELECT 'n/' || n_nationkey AS query_scope, id, row_number() OVER (PARTITION BY n_nationkey ORDER BY since, id) AS rank FROM nation JOIN j ON j.scope IN ('', 'n', 'n/' || n_nationkey) QUALIFY rank <= 500""")
def s12(spark, sf_dir):
    scopes = table(spark, sf_dir, "nation").select(F.concat(F.lit("n/"), C("n_nationkey").cast("string")).alias("query_scope"))
    return embed.pending_jobs(scopes, _jobs(spark, sf_dir)).select("query_scope", "id", "rank")


@register("s13_job_outcomes", f"""WITH {_EMBEDDABLE_SQL} SELECT record_type || '-' || record_id AS id, CASE WHEN record_id::BIGINT % 5 = 0 OR record_id::BIGINT % 3 = 0 THEN 'skipped' ELSE 'embedded' END AS outcome,
  CASE WHEN record_id::BIGINT % 5 = 0 THEN 'record no longer exists' WHEN record_id::BIGINT % 3 = 0 THEN 'record content changed' END AS error FROM x WHERE record_type IN ('observation', 'context')""")
def s13(spark, sf_dir):
    return embed.embed(_jobs(spark, sf_dir), _embeddable(spark, sf_dir))[1]


@register("s13_stored_vectors", f"""WITH {_EMBEDDABLE_SQL} SELECT record_type, record_id, CASE WHEN record_id::BIGINT % 5 = 0 OR record_id::BIGINT % 3 = 0 THEN 'old' ELSE sha256(trim(content)) END AS content_hash FROM x WHERE record_type = 'observation'
  UNION ALL SELECT record_type, record_id, sha256(trim(content)) FROM x WHERE record_type = 'context' AND record_id::BIGINT % 5 <> 0 AND record_id::BIGINT % 3 <> 0""")
def s13v(spark, sf_dir):
    records = _embeddable(spark, sf_dir)
    made, _ = embed.embed(_jobs(spark, sf_dir), records)
    base = records.where("record_type = 'observation'").select("record_type", "record_id", "scope", F.lit("local").alias("provider"), F.lit("hash").alias("model"), F.lit(64).alias("dimension"), F.lit("old").alias("content_hash"), F.array_repeat(F.lit(0.0), 64).alias("embedding"), F.lit("").alias("job"))
    return embed.store_vectors(base, made).select("record_type", "record_id", "content_hash")


@register("u1_sections", """WITH r AS (SELECT source AS qid, 0 AS s, 'entity' AS record_type, lang AS id, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents GROUP BY source, lang QUALIFY r <= 4
  UNION ALL SELECT source, 1, 'observation', doc_id::VARCHAR, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 10)
  SELECT qid, record_type, id, row_number() OVER (PARTITION BY qid ORDER BY s, r, id) AS rank FROM r QUALIFY rank <= 10""")
def u1(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    langs = search.top(d.groupBy(C("source").alias("qid"), C("lang").alias("id")).agg(F.count("*").alias("n")), ["qid"], [C("n").desc(), C("id")], 4)
    docs = search.top(d.select(C("source").alias("qid"), C("doc_id").alias("id"), "n_chars"), ["qid"], [C("n_chars").desc(), C("id")], 10)
    return embed.sections({"observation": docs, "entity": langs}, 10)


# details


@register("p9_record_detail", """WITH e AS (SELECT l_suppkey AS id, 'p' || l_partkey AS other, count(*) AS w FROM lineitem GROUP BY ALL), n AS (SELECT id, string_agg('supplies:' || other, ',' ORDER BY w DESC, other) AS related FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, other) <= 12) GROUP BY id),
  v AS (SELECT user_id AS id, string_agg(event_type || ':' || event_id, ',' ORDER BY ts DESC, event_id DESC) AS events FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 8) GROUP BY 1)
  SELECT s_suppkey AS id, s_name AS title, 'nation=' || s_nationkey || CASE WHEN s_suppkey % 2 = 0 THEN ',even=' || s_suppkey ELSE '' END AS metadata, coalesce(related, '') AS related, coalesce(events, '') AS events FROM supplier LEFT JOIN n ON n.id = s_suppkey LEFT JOIN v ON v.id = s_suppkey""")
def p9(spark, sf_dir):
    records = table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("title"), C("s_nationkey").alias("nation"), F.when(C("s_suppkey") % 2 == 0, C("s_suppkey")).alias("even"))
    related = table(spark, sf_dir, "lineitem").groupBy(C("l_suppkey").alias("id"), F.concat(F.lit("p"), C("l_partkey").cast("string")).alias("other")).agg(F.count("*").alias("weight")).withColumn("relation", F.lit("supplies"))
    events = table(spark, sf_dir, "events").select(C("user_id").alias("target_id"), "event_type", C("ts").alias("created_at"), "event_id")
    return detail.record_detail(records, {"nation": "nation", "even": "even"}, related, events)


@register("a18_snapshot", """SELECT query_scope, section, coalesce(body, 'unavailable') AS body FROM (SELECT n_nationkey::VARCHAR AS query_scope, 'suppliers' AS section, CASE WHEN count(s_suppkey) > 0 THEN count(s_suppkey)::VARCHAR END AS body FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1
  UNION ALL SELECT n_nationkey::VARCHAR, 'customers', CASE WHEN count(c_custkey) > 0 THEN count(c_custkey)::VARCHAR END FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_nationkey % 2 = 0 GROUP BY 1)""")
def a18(spark, sf_dir):
    scopes = table(spark, sf_dir, "nation").select(C("n_nationkey").cast("string").alias("query_scope"))
    n = lambda t, key: table(spark, sf_dir, t).groupBy(C(key).cast("string").alias("query_scope")).agg(F.count("*").cast("string").alias("body"))
    return detail.snapshot(scopes, {"suppliers": n("supplier", "s_nationkey"), "customers": n("customer", "c_nationkey").where("query_scope % 2 = 0")})


# datasets


@register("s15_judgements", "SELECT doc_id::VARCHAR AS qid, source AS id, quality + toxic AS grade FROM documents JOIN labels USING (doc_id) WHERE doc_id % 10 > 1")
def s15(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    line = F.concat_ws("\t", C("doc_id").cast("string"), "source", F.when(C("doc_id") % 10 == 1, "x").otherwise((C("quality") + C("toxic")).cast("string")))
    return datasets.judgements(rows.select(F.when(C("doc_id") % 10 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"), F.lit(False).alias("header")))[0]


@register("s15_problems", """SELECT 'unknown document' AS problem, doc_id::VARCHAR AS id FROM labels WHERE doc_id % 5 = 0 UNION ALL SELECT 'duplicate query', source FROM documents GROUP BY source HAVING count(*) > 1
  UNION ALL SELECT DISTINCT 'unknown query', 'q' || quality FROM labels""")
def s15p(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    qrels = table(spark, sf_dir, "labels").select(F.concat(F.lit("q"), C("quality").cast("string")).alias("qid"), C("doc_id").alias("id"))
    return datasets.problems(d.where("doc_id % 5 <> 0").select("doc_id"), d.select(C("source").alias("qid")), qrels)


# comparisons


def _pooled(spark, sf_dir):
    """Runs of the benchmark items over the documents by three modes, and judgements of what they found: a document is relevant that holds the item's first words."""
    d = table(spark, sf_dir, "documents")
    records = d.select(C("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("title"), C("text").alias("content"))
    queries = table(spark, sf_dir, "benchmark").select(C("item_id").alias("qid"), C("text").alias("query"))
    content = records.select("id", "content")
    words = stored(search.keyword_search(queries, content, 30), "words")  # as deep as hybrid search takes them; the first ranks are those of a search that takes fewer
    near = assist.semantic_arm(queries, content, 30)
    runs = {mode: stored(assist.find(queries, records, mode, words=words, near=near).select("qid", "id", "rank"), mode) for mode in ("keyword", "semantic", "hybrid")}
    pool = runs["keyword"].unionByName(runs["semantic"]).unionByName(runs["hybrid"]).select("qid", "id").distinct()
    held = F.contains("content", F.substring("query", 1, 60))
    qrels = pool.join(queries, "qid").join(assist.named(content, pool), "id").select("qid", "id", held.cast("int").alias("grade"))
    return queries, records, runs, stored(qrels.where("grade > 0"), "judged")


@register("e6_e8_mode_comparison")
def e8(spark, sf_dir):
    """Hybrid search against keywords and vectors alone, over the benchmark items."""
    queries, _, runs, qrels = _pooled(spark, sf_dir)
    rows = None
    for mode, run in runs.items():
        one = evaluate.metrics(run, qrels).select(F.lit(mode).alias("mode"), "qid", C("ndcg_10").alias("x"))
        rows = one if rows is None else rows.unionByName(one)
    return evaluate.compare_modes(rows)


@register("e11_reflection_lift")
def e11(spark, sf_dir):
    """Keyword search of the benchmark items before and after the themes of the supplier-part graph are indexed; documents are observations of suppliers."""
    queries, records, _, qrels = _pooled(spark, sf_dir)
    n = table(spark, sf_dir, "supplier").count()
    nodes = mapping.entities(spark, sf_dir).select("id", C("id").alias("name"))
    observed = mapping.observations(spark, sf_dir).where("valid_to IS NULL").select("id", F.concat(F.lit("s"), (C("id") % n + 1).cast("string")).alias("entity_id"), "content", "category", "confidence", F.lit(1.0).alias("salience"))
    text = lambda df: df.withColumn("id", C("id").cast("string"))
    found = reflection_lift(nodes, mapping.relations(spark, sf_dir), observed, queries, text(records.select("id", "content")), text(qrels), most=1_000_000)
    counts = found.rerun.select(F.explode(F.array(*[F.struct(F.lit(f"rerun_{c}").alias("metric"), C(c).cast("double").alias("before")) for c in found.rerun.columns])).alias("x")).select("x.*")
    return found.metrics.unionByName(counts.select("metric", "before", C("before").alias("after"), F.lit(0.0).alias("lift")))


# bundles, counts, briefings


@register("s10_merged_report", """WITH i AS (SELECT n_nationkey AS id, n_nationkey % 7 AS parent, n_nationkey % 3 AS v FROM nation), c AS (SELECT c_custkey AS id, c_nationkey AS parent, c_custkey % 3 AS v FROM customer WHERE c_custkey % 2 = 0),
  r AS (SELECT 'regions' AS t, CASE WHEN x >= 5 THEN 'inserted' ELSE 'kept' END AS o FROM (SELECT DISTINCT n_nationkey % 7 AS x FROM nation)
  UNION ALL SELECT 'nations', CASE WHEN id < 20 THEN CASE WHEN v > 1 THEN 'replaced' ELSE 'kept' END ELSE 'inserted' END FROM i
  UNION ALL SELECT 'customers', CASE WHEN parent % 5 = 4 THEN 'orphan' WHEN id % 4 = 0 THEN 'replaced' ELSE 'inserted' END FROM (SELECT id, CASE WHEN parent % 5 = 4 THEN 9004 ELSE parent END AS parent FROM c))
  SELECT t AS "table", o AS outcome, count(*) AS n FROM r GROUP BY ALL""")
def s10m(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    regions, nations = t("nation").select((C("n_nationkey") % 7).alias("id")).distinct(), t("nation").select(C("n_nationkey").alias("id"), (C("n_nationkey") % 7).alias("parent"), (C("n_nationkey") % 3).alias("at"))
    customers = t("customer").where("c_custkey % 2 = 0").select(C("c_custkey").alias("id"), F.when(C("c_nationkey") % 5 == 4, 9004).otherwise(C("c_nationkey")).alias("parent"))
    base = {"regions": regions.where("id < 5"), "nations": nations.where("id < 20").withColumn("at", F.lit(1)), "customers": customers.where("id % 4 = 0")}
    rules = {"regions": assist.Merge("id", "keep"), "nations": assist.Merge("id", "newer", "at", (("parent", "regions"),)), "customers": assist.Merge("id", "replace", None, (("parent", "nations"),))}
    return assist.merge_bundle(base, {"regions": regions, "nations": nations, "customers": customers}, rules)[1]


def _sectioned(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    region = lambda key: F.concat(F.lit("r/"), (C(key) % 5).cast("string"))
    rows = lambda df, scope, id_, line, at: df.select(scope.alias("scope"), C(id_).alias("id"), line.alias("line"), C(at).alias("at"))
    return {
        "decisions": (rows(t("orders").where("o_orderstatus = 'F'"), region("o_custkey"), "o_orderkey", C("o_orderpriority"), "o_orderdate"), 10),
        "state": (rows(t("orders").where("o_orderstatus = 'O'"), region("o_custkey"), "o_orderkey", C("o_orderpriority"), "o_orderdate"), 10),
        "sessions": (rows(t("orders").where("o_orderstatus = 'P'"), F.lit(""), "o_orderkey", C("o_orderpriority"), "o_orderdate"), 5),
        "observations": (rows(t("events").where("event_type <> 'error'"), region("user_id"), "event_id", C("event_type"), "ts"), 15),
        "events": (rows(t("events"), region("user_id"), "event_id", C("event_type"), "ts"), 5),
    }


_SECTIONED = """z AS (SELECT 'decisions' AS section, 10 AS k, 'r/' || (o_custkey % 5) AS scope, o_orderkey AS id, o_orderpriority AS line, o_orderdate AS ts FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'state', 10, 'r/' || (o_custkey % 5), o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'sessions', 5, '', o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'observations', 15, 'r/' || (user_id % 5), event_id, event_type, ts FROM events WHERE event_type <> 'error'
  UNION ALL SELECT 'events', 5, 'r/' || (user_id % 5), event_id, event_type, ts FROM events), q AS (SELECT 'r/' || r_regionkey AS query_scope FROM region)"""


@register("a1_all_scoped_counts", f"""WITH {_SECTIONED} SELECT query_scope, count(*) FILTER (section = 'decisions') AS decisions, count(*) FILTER (section = 'state') AS state, count(*) FILTER (section = 'sessions') AS sessions, count(*) FILTER (section = 'observations') AS observations, count(*) FILTER (section = 'events') AS events FROM q LEFT JOIN z ON scope IN ('', query_scope) GROUP BY 1""")
def a1_all(spark, sf_dir):
    scopes = table(spark, sf_dir, "region").select(F.concat(F.lit("r/"), C("r_regionkey").cast("string")).alias("query_scope"))
    return listing.counts(scopes, {name: rows for name, (rows, _) in _sectioned(spark, sf_dir).items()})


@register("r10_full_briefing", f"""WITH {_SECTIONED}, r AS (SELECT query_scope, section, k, id, line, row_number() OVER (PARTITION BY query_scope, section ORDER BY ts DESC, id) AS n FROM q JOIN z ON scope IN ('', query_scope))
  SELECT query_scope, section, string_agg('- ' || id || ' ' || line, chr(10) ORDER BY n) AS lines FROM r WHERE n <= k GROUP BY 1, 2""")
def r10_full(spark, sf_dir):
    scopes = table(spark, sf_dir, "region").select(F.concat(F.lit("r/"), C("r_regionkey").cast("string")).alias("query_scope"))
    line = F.format_string("- %d %s", C("id"), C("line"))
    return listing.briefing(scopes, {name: (rows, line, [C("at").desc(), C("id")], k) for name, (rows, k) in _sectioned(spark, sf_dir).items()})


_CATEGORIES = ["knowledge_update", "decision_reversal", "retraction", "distractor_noise", "false_positive"]


@register("e9_supersession_report", f"""WITH s AS (SELECT {_sql_pick(_CATEGORIES, 'doc_id')} AS category, contains(lower(text), 'the') AS f, NOT contains(lower(text), 'was') AS g, doc_id % 5 = 2 AS x, n_chars > 500 AS a FROM documents)
  SELECT category, count(*) AS items, count(*) FILTER (CASE WHEN x THEN NOT a ELSE f AND g END) AS passed, count(*) FILTER (NOT g AND NOT x) AS stale_leaks, count(*) FILTER (x AND NOT a) AS abstain_right, count(*) FILTER (category IN ('distractor_noise', 'false_positive') AND NOT f) AS false_supersessions FROM s GROUP BY 1""")
def e9r(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    items = docs.select(C("doc_id").alias("item"), F.array(F.lit("The")).alias("required"), F.array(F.lit("was")).alias("forbidden"))
    scores = evidence.supersession_scores(items, docs.select(C("doc_id").alias("item"), C("text").alias("content")))
    known = docs.select(C("doc_id").alias("item"), _pick(_CATEGORIES, C("doc_id")).alias("category"), (C("doc_id") % 5 == 2).alias("expect_abstain"), (C("n_chars") > 500).alias("answered"))
    return evidence.supersession_report(scores.join(known, "item"))


@register("r1_stemmed_search")
def r1s(spark, sf_dir):
    queries = table(spark, sf_dir, "benchmark").select(C("item_id").alias("qid"), C("text").alias("query"))
    return search.keyword_search(queries, table(spark, sf_dir, "documents").select(C("doc_id").alias("id"), C("text").alias("content")), stem=True)
