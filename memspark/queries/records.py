"""Queries over records: sources, listings, changes, facts, curation, redaction and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.functions import scoring
from memspark.operators import changes, curation, evaluate, listing, redact
from memspark.operators.search import top
from memspark.plans import mapping
from memspark.sources import transcripts
from memspark.streaming.ingest import prepared
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


# sources


@register("s2_transcript_jsonl", """SELECT conv_id::VARCHAR AS source, turn AS idx, CASE WHEN lower(role) IN ('human', 'user') THEN 'user' WHEN lower(role) IN ('ai', 'assistant', 'model', 'agent') THEN 'assistant' ELSE lower(role) END AS role, trim(text) AS text
  FROM conversations WHERE trim(text) <> '' AND turn % 5 <> 4""")
def s2(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    line = F.when(C("turn") % 5 == 4, F.lit("{broken")).otherwise(F.to_json(F.struct("role", C("text").alias("content"))))
    return transcripts.parse_jsonl(t.select(C("conv_id").cast("string").alias("source"), C("turn").alias("idx"), line.alias("value")))


@register("s3_transcript_json", """SELECT conv_id AS source, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS idx, CASE WHEN lower(role) IN ('human', 'user') THEN 'user' WHEN lower(role) IN ('ai', 'assistant', 'model', 'agent') THEN 'assistant' ELSE lower(role) END AS role, trim(text) AS text
  FROM conversations QUALIFY trim(text) <> ''""")
def s3(spark, sf_dir):
    turn = F.struct("turn", "role", C("text").alias("body"))
    whole = table(spark, sf_dir, "conversations").groupBy(C("conv_id").alias("source")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(turn)).alias("turns"))).alias("value"))
    return transcripts.parse_json(whole)


@register("s4_transcript_text", """WITH c AS (SELECT conv_id AS source, string_agg(role || ': ' || regexp_replace(text, '\\n+', ' ', 'g'), chr(10) || chr(10) ORDER BY turn) AS value FROM conversations GROUP BY conv_id),
  x AS (SELECT source, unnest(regexp_split_to_array(value, '\\n[ \\t]*\\n+')) AS chunk, generate_subscripts(regexp_split_to_array(value, '\\n[ \\t]*\\n+'), 1) - 1 AS idx FROM c)
  SELECT source, CAST(idx AS INTEGER) AS idx, CASE lower(regexp_extract(trim(chunk), '(?i)^(user|human|assistant|ai|system|tool):', 1)) WHEN '' THEN 'unknown' WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' ELSE lower(regexp_extract(trim(chunk), '(?i)^(user|human|assistant|ai|system|tool):', 1)) END AS role,
    trim(regexp_replace(trim(chunk), '(?i)^(user|human|assistant|ai|system|tool):\\s*', '')) AS text FROM x WHERE trim(chunk) <> ''""")
def s4(spark, sf_dir):
    turn = F.struct("turn", F.concat("role", F.lit(": "), F.regexp_replace("text", "\n+", " ")).alias("t"))
    whole = table(spark, sf_dir, "conversations").groupBy(C("conv_id").alias("source")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x["t"]), "\n\n").alias("value"))
    return transcripts.parse_text(whole)


@register("s7_terminal_shape", """SELECT event_id, 'Terminal: ' || event_type AS title, '$ ' || event_type || chr(10) || 'exit: ' || (event_id % 3) AS text FROM events""")
def s7(spark, sf_dir):
    lines = F.concat_ws("\n", F.concat(F.lit("$ "), "event_type"), F.concat(F.lit("exit: "), (C("event_id") % 3).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("Terminal: "), F.substring("event_type", 1, 96)).alias("title"), lines.alias("text"))


@register("s9_git_status", """WITH l AS (SELECT o_custkey AS id, o_orderkey AS n, o_orderstatus AS s, 'src/' || o_orderpriority AS path FROM orders), g AS (SELECT id, s, path, min(n) AS n FROM l GROUP BY ALL),
  f AS (SELECT id, path, min(n) AS n FROM l GROUP BY ALL)
  SELECT id, a AS changed, coalesce(b, '') AS staged, coalesce(c, '') AS unstaged, coalesce(d, '') AS untracked FROM (SELECT id, string_agg(path, '|' ORDER BY n) AS a FROM f GROUP BY id)
  LEFT JOIN (SELECT id, string_agg(path, '|' ORDER BY n) FILTER (s = 'F') AS b, string_agg(path, '|' ORDER BY n) FILTER (s = 'O') AS c, string_agg(path, '|' ORDER BY n) FILTER (s NOT IN ('F', 'O')) AS d FROM g GROUP BY id) USING (id)""")
def s9(spark, sf_dir):
    code = F.when(C("o_orderstatus") == "F", "R  old -> ").when(C("o_orderstatus") == "O", " M ").otherwise("?? ")
    line = F.struct("o_orderkey", F.concat(code, F.lit("src/"), "o_orderpriority").alias("l"))
    texts = table(spark, sf_dir, "orders").groupBy(C("o_custkey").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("value"))
    return transcripts.parse_git_status(texts).select("id", *[F.array_join(c, "|").alias(c) for c in ("changed", "staged", "unstaged", "untracked")])


@register("p8_blocked_paths", """SELECT page_id, path FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages) WHERE NOT (contains(path, '/1/') OR starts_with(path, 'www.') AND false OR contains('/' || path || '/', '/blog/'))""")
def p8(spark, sf_dir):
    blocks = spark.createDataFrame([("1",), ("blog",)], "prefix string")
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    found = transcripts.blocked(paths.withColumn("path", F.concat(F.lit("/"), "path", F.lit("/"))), blocks)
    return found.select("page_id", F.regexp_replace("path", "^/|/$", "").alias("path"))


@register("s6_st1_prepared_events", """SELECT conv_id, turn, text <> r AS redacted, r AS text, CASE WHEN text <> r THEN 'sensitive' ELSE 'internal' END AS privacy_level FROM (SELECT *, regexp_replace(regexp_replace(text, '(?im)([A-Za-z0-9_-]*(?:password|secret|token)[A-Za-z0-9_-]*)[^\\S\\n]*=.*$', '\\1=[REDACTED_SECRET]', 'g'),
  '(?im)([A-Za-z0-9_-]*(?:password|secret|token)[A-Za-z0-9_-]*)[^\\S\\n]*:.*$', '\\1: [REDACTED_SECRET]', 'g') AS r FROM (SELECT conv_id, turn, text || CASE turn WHEN 0 THEN chr(10) || 'db_password = hunter' || conv_id ELSE '' END AS text FROM conversations))""")
def s6(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", F.when(C("turn") == 0, F.concat(F.lit("\ndb_password = hunter"), C("conv_id").cast("string"))).otherwise("")))
    shaped = t.withColumns({"scope": F.lit(""), "source_type": F.lit("transcript"), "source": C("conv_id").cast("string"), "title": C("role"), "privacy_level": F.lit("internal")})
    return prepared(shaped).select("conv_id", "turn", "redacted", "text", "privacy_level")


# redaction


@register("x1_assignments", r"""SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?im)([A-Za-z0-9_-]*(?:api_key|apikey|access_token|auth_token|client_secret|secret|password|passwd|passphrase|private_key|github_token|openai_api_key|anthropic_api_key|token|credential|bearer|access_key)[A-Za-z0-9_-]*)[^\S\n]*=.*$', '\1=[REDACTED_SECRET]', 'g'),
  '(?im)([A-Za-z0-9_-]*(?:api_key|apikey|access_token|auth_token|client_secret|secret|password|passwd|passphrase|private_key|github_token|openai_api_key|anthropic_api_key|token|credential|bearer|access_key)[A-Za-z0-9_-]*)[^\S\n]*:.*$', '\1: [REDACTED_SECRET]', 'g') AS text FROM documents""")
def x1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redact.assignments(C("text")).alias("text"))


@register("x3_x5_redacted_text")
def x5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redact.redacted(C("text")).alias("r")).select("doc_id", "r.text", "r.changed")


@register("x4_redacted_json")
def x4(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", redact.redacted_json("props").alias("props"))


# joins, aggregations and windows over the audit log


@register("p6_event_log", "SELECT user_id, event_id, event_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank FROM events WHERE event_id > 1000) WHERE rank <= 5")
def p6(spark, sf_dir):
    return top(table(spark, sf_dir, "events").where("event_id > 1000"), ["user_id"], [C("event_id").desc()], 5).select("user_id", "event_id", "event_type", "rank")


@register("a6_reuse_per_record", "SELECT user_id AS id, count(*) AS uses, max(ts) AS last FROM events GROUP BY user_id")
def a6(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(C("user_id").alias("id")).agg(F.count("*").alias("uses"), F.max("ts").alias("last"))


@register("a7_source_mix", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS mix FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def a7(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat("event_type", F.lit("="), C("n").cast("string")))), ",").alias("mix"))


@register("a4_status_histogram", "SELECT o_orderstatus AS status, count(*) AS jobs, count(DISTINCT o_custkey) AS scopes FROM orders GROUP BY 1")
def a4(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(C("o_orderstatus").alias("status")).agg(F.count("*").alias("jobs"), F.countDistinct("o_custkey").alias("scopes"))


@register("a5_index_freshness", "SELECT count(*) AS embeddable, count(*) FILTER (doc_id % 3 <> 0) AS indexed, count(*) FILTER (doc_id % 3 = 1) AS fresh, count(*) - count(*) FILTER (doc_id % 3 = 1) AS missing_or_stale FROM documents")
def a5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(C("doc_id").alias("id"), F.sha2("text", 256).alias("hash"))
    index = docs.where("id % 3 <> 0").select("id", F.when(C("id") % 3 == 1, C("hash")).otherwise("old").alias("indexed_hash"))
    both = docs.join(index, "id", "left").agg(F.count("*").alias("embeddable"), F.count("indexed_hash").alias("indexed"), F.count_if(C("hash") == C("indexed_hash")).alias("fresh"))
    return both.withColumn("missing_or_stale", C("embeddable") - C("fresh"))


@register("a9_term_statistics", """WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents) SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY term""")
def a9(spark, sf_dir):
    from memspark.operators.search import index_tokens

    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(index_tokens(C("text"))).alias("term"))
    per = t.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))


_STOP = "('" + "', '".join(__import__("memspark.functions.text", fromlist=["STOP_WORDS"]).STOP_WORDS) + "')"


@register("a10_keywords", f"""WITH t AS (SELECT source AS "group", unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_-]+'), lambda x: length(x) > 1)) AS term FROM documents)
  SELECT "group", term, count(*) AS n, row_number() OVER (PARTITION BY "group" ORDER BY count(*) DESC, term) AS rank FROM t WHERE term NOT IN {_STOP} GROUP BY 1, 2 QUALIFY rank <= 12""")
def a10(spark, sf_dir):
    return listing.keywords(table(spark, sf_dir, "documents").select(C("source").alias("group"), C("text").alias("content")))


@register("w5_first_duplicate", "SELECT doc_id, source, md5(text) AS h FROM documents QUALIFY row_number() OVER (PARTITION BY source, md5(text) ORDER BY doc_id) = 1")
def w5(spark, sf_dir):
    return changes.first_of(table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("h")), ["source", "h"], [C("doc_id")])


@register("w6_latest_session", "SELECT user_id, arg_max(event_id, ts) AS latest FROM (SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY user_id")
def w6(spark, sf_dir):
    return changes.first_of(table(spark, sf_dir, "events"), ["user_id"], [C("ts").desc(), C("event_id").desc()]).select("user_id", C("event_id").alias("latest"))


@register("w7_fact_succession", "SELECT user_id, event_id, lag(event_type) OVER w AS previous, lead(ts) OVER w AS valid_to FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w7(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_type").over(w).alias("previous"), F.lead("ts").over(w).alias("valid_to"))


# scoped listings


def _scopes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("region/"), C("n_regionkey").cast("string"), F.lit("/nation/"), C("n_nationkey").cast("string")).alias("query_scope"))


def _decisions(spark, sf_dir):
    scope = F.concat(F.lit("region/"), (C("o_custkey") % 5).cast("string"))
    return table(spark, sf_dir, "orders").select(F.when(C("o_orderkey") % 4 == 0, F.lit("")).otherwise(scope).alias("scope"), C("o_orderkey").alias("id"), C("o_orderdate").alias("created_at"), C("o_orderstatus").alias("status"))


_SCOPES_SQL = """scopes AS (SELECT 'region/' || n_regionkey || '/nation/' || n_nationkey AS query_scope, 'region/' || n_regionkey AS parent FROM nation),
  decisions AS (SELECT CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'region/' || (o_custkey % 5) END AS scope, o_orderkey AS id, o_orderdate AS created_at, o_orderstatus AS status FROM orders),
  seen AS (SELECT query_scope, d.* FROM scopes JOIN decisions d ON d.scope IN ('', parent))"""


@register("j10_p7_scoped_listing", f"WITH {_SCOPES_SQL} SELECT query_scope, id, status, row_number() OVER (PARTITION BY query_scope ORDER BY created_at DESC, id) AS rank FROM seen WHERE status = 'O' QUALIFY rank <= 10")
def p7(spark, sf_dir):
    found = listing.list_records(_scopes(spark, sf_dir), _decisions(spark, sf_dir), [C("created_at").desc(), C("id")], 10, C("status") == "O")
    return found.select("query_scope", "id", "status", "rank")


@register("a1_scoped_counts", f"WITH {_SCOPES_SQL} SELECT query_scope, count(*) FILTER (status = 'O') AS open, count(*) FILTER (status = 'F') AS done FROM seen GROUP BY query_scope")
def a1(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return listing.counts(_scopes(spark, sf_dir), {"open": d.where("status = 'O'"), "done": d.where("status = 'F'")})


@register("r10_briefing", f"""WITH {_SCOPES_SQL}, r AS (SELECT query_scope, CASE status WHEN 'O' THEN 'state' ELSE 'decisions' END AS section, id, status, row_number() OVER (PARTITION BY query_scope, status ORDER BY created_at DESC, id) AS n FROM seen WHERE status IN ('O', 'F'))
  SELECT query_scope, section, string_agg('- ' || id || ' [' || status || ']', chr(10) ORDER BY n) AS lines FROM r WHERE n <= CASE section WHEN 'state' THEN 5 ELSE 10 END GROUP BY ALL""")
def r10(spark, sf_dir):
    d, line = _decisions(spark, sf_dir), F.format_string("- %d [%s]", C("id"), C("status"))
    order = [C("created_at").desc(), C("id")]
    return listing.briefing(_scopes(spark, sf_dir), {"decisions": (d.where("status = 'F'"), line, order, 10), "state": (d.where("status = 'O'"), line, order, 5)})


# changes


def _state(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(C("o_orderkey").alias("id"), C("o_orderstatus").alias("status"), C("o_totalprice").alias("value"), C("o_orderdate").alias("created_at"), F.lit(1).alias("version"))


@register("u3_upsert", """WITH c AS (SELECT l_orderkey AS id, arg_max(l_returnflag, (l_linenumber, l_extendedprice, l_partkey)) AS status, arg_max(l_extendedprice, (l_linenumber, l_extendedprice, l_partkey)) AS value FROM lineitem WHERE l_quantity > 40 GROUP BY 1)
  SELECT id, coalesce(c.status, o_orderstatus) AS status, round(coalesce(c.value, o_totalprice), 2) AS value, o_orderdate AS created_at, 1 AS version FROM (SELECT o_orderkey AS id, * FROM orders) LEFT JOIN c USING (id)""")
def u3(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 40")
    new = lines.select(C("l_orderkey").alias("id"), C("l_returnflag").alias("status"), C("l_extendedprice").alias("value"), C("l_shipdate").alias("created_at"), F.lit(1).alias("version"), F.struct("l_linenumber", "l_extendedprice", "l_partkey").alias("place"))
    return changes.upsert_latest(_state(spark, sf_dir), new, ["id"], [C("place").desc()], keep=("created_at",)).withColumn("value", F.round("value", 2))


@register("u4_insert_new", "SELECT l_partkey AS id, min(l_orderkey) AS first FROM lineitem WHERE l_partkey % 2 = 1 GROUP BY 1")
def u4(spark, sf_dir):
    base = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(C("p_partkey").alias("id"))
    rows = table(spark, sf_dir, "lineitem").select(C("l_partkey").alias("id"), C("l_orderkey").alias("first"))
    return changes.insert_new(base, rows, ["id"], [C("first")])


@register("u5_delete_cascade", f"WITH {mapping.RELATIONS_SQL} SELECT * FROM relations WHERE substr(src, 2)::BIGINT % 3 <> 0 AND substr(dst, 2)::BIGINT % 5 <> 0")
def u5(spark, sf_dir):
    gone = mapping.entities(spark, sf_dir).select("id", F.substring("id", 1, 1).alias("k"), F.substring("id", 2, 20).cast("long").alias("n"))
    gone = gone.where("k = 's' AND n % 3 = 0 OR k = 'p' AND n % 5 = 0")
    return changes.delete_cascade(mapping.relations(spark, sf_dir), gone, "src", "dst").select("src", "dst", "weight")


@register("u5_soft_delete", f"WITH {mapping.OBSERVATIONS_SQL} SELECT id, CASE WHEN id % 5 = 0 AND valid_to IS NULL THEN TIMESTAMP '2025-01-01' ELSE valid_to END AS valid_to FROM observations")
def u5s(spark, sf_dir):
    o = mapping.observations(spark, sf_dir)
    return changes.close(o, o.where("id % 5 = 0").select("id"), F.lit("2025-01-01 00:00:00").cast("timestamp")).select("id", "valid_to")


@register("u6_partial_update", """WITH c AS (SELECT l_orderkey AS id, arg_max(l_returnflag, (l_linenumber, l_extendedprice, l_partkey)) FILTER (l_linenumber % 2 = 0) AS status, count(*) AS n FROM lineitem GROUP BY 1)
  SELECT id, coalesce(c.status, o_orderstatus) AS status, 1 + coalesce(n, 0) AS version FROM (SELECT o_orderkey AS id, * FROM orders) LEFT JOIN c USING (id)""")
def u6(spark, sf_dir):
    commands = table(spark, sf_dir, "lineitem").select(C("l_orderkey").alias("id"), F.struct("l_linenumber", "l_extendedprice", "l_partkey").alias("place"), F.when(C("l_linenumber") % 2 == 0, C("l_returnflag")).alias("status"))
    return changes.patch(_state(spark, sf_dir), commands, "id", ["status"], "place", "version").select("id", "status", "version")


@register("u7_emitted_events", "SELECT sha256('order_' || o_orderstatus || chr(31) || o_orderkey || chr(31) || '2024-01-01')[1:26] AS id, 'order_' || o_orderstatus AS event_type, o_orderkey::VARCHAR AS target_id, '2024-01-01' AS created_at FROM orders")
def u7(spark, sf_dir):
    return changes.emitted(table(spark, sf_dir, "orders"), F.concat(F.lit("order_"), "o_orderstatus"), C("o_orderkey"), F.lit("2024-01-01"))


# facts


@register("b5_supersede", f"""WITH {mapping.OBSERVATIONS_SQL}, o AS (SELECT *, CASE source_type WHEN 'manual' THEN 3 WHEN 'agent:transcript' THEN 2 ELSE 1 END AS t FROM observations),
  p AS (SELECT a.id AS id, b.id AS by_id, CASE WHEN b.t > a.t THEN 'source_priority' WHEN b.t = a.t THEN 'recency' END AS basis FROM o a JOIN o b ON a.id = b.id - 20 AND a.entity_id = b.entity_id WHERE a.valid_to IS NULL AND b.t >= a.t)
  SELECT * FROM p""")
def b5(spark, sf_dir):
    o = mapping.observations(spark, sf_dir)
    return changes.supersede(o, o.withColumn("supersedes", C("id") - 20))[1]


@register("b5_as_of", f"WITH {mapping.OBSERVATIONS_SQL} SELECT id, entity_id FROM observations WHERE valid_from <= TIMESTAMP '2024-01-25' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-25')")
def b5a(spark, sf_dir):
    return changes.as_of(mapping.observations(spark, sf_dir), F.lit("2024-01-25 00:00:00").cast("timestamp")).select("id", "entity_id")


@register("b7_conflict_hint", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) ** 2)))) AS u FROM embeddings),
  p AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_dot_product(a.u, b.u), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id % 20 = 0 AND b.vec_id < a.vec_id)
  SELECT id, other AS supersedes, similarity FROM p WHERE similarity >= 0.2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) = 1""")
def b7(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    new = v.where("vec_id % 20 = 0").select(C("vec_id").alias("id"), "label", C("embedding").alias("a"))
    pairs = new.join(v.select(C("vec_id").alias("other"), "label", C("embedding").alias("b")), "label").where("other < id")
    pairs = pairs.withColumn("similarity", F.round(scoring.cosine(C("a"), C("b")), 6)).where("similarity >= 0.2")
    return top(pairs, ["id"], [C("similarity").desc(), C("other")], 1).select("id", C("other").alias("supersedes"), "similarity")


# curation


def _candidates(spark, sf_dir):
    return mapping.observations(spark, sf_dir).select("id", "source_type", "confidence", F.when(C("id") % 4 == 0, "approved").otherwise("pending").alias("status"), "content", C("valid_from").alias("created_at"))


@register("c2_active_learning", f"""WITH {mapping.OBSERVATIONS_SQL}, e AS (SELECT doc_id AS id, count(*) AS n FROM labels GROUP BY 1), c AS (SELECT o.id, coalesce(n, 0) AS evidence_count,
  1 - (1 - CASE source_type WHEN 'manual' THEN 0.9 WHEN 'inferred' THEN 0.5 ELSE 0.6 END::DOUBLE) * 0.7 ** coalesce(n, 0) AS k FROM observations o LEFT JOIN e USING (id))
  SELECT id, evidence_count, round(k, 6) AS calibrated, round(1 - 2 * abs(k - 0.5), 6) AS uncertainty, round((1 - 2 * abs(k - 0.5)) * (1 + ln(1 + evidence_count)), 6) AS review_priority FROM c""")
def c2(spark, sf_dir):
    evidence = table(spark, sf_dir, "labels").select(C("doc_id").alias("candidate_id"))
    return curation.calibrated_candidates(_candidates(spark, sf_dir), evidence).select("id", "evidence_count", "calibrated", "uncertainty", "review_priority")


_REVIEW = """WITH c AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 0 THEN 'approved' ELSE 'pending' END AS status FROM documents),
  k AS (SELECT user_id AS id, event_id AS place, row_number() OVER w AS n, CASE WHEN event_id % 2 = 0 THEN 'approved' ELSE 'rejected' END AS done, first_value(CASE WHEN event_id % 2 = 0 THEN 'approved' ELSE 'rejected' END) OVER w AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  r AS (SELECT id, place, done, CASE WHEN status IS NULL THEN 'not found' WHEN status <> 'pending' THEN 'already ' || status WHEN n > 1 THEN 'already ' || f END AS error FROM k LEFT JOIN c USING (id))"""


def _review(spark, sf_dir):
    commands = table(spark, sf_dir, "events").select(C("user_id").alias("id"), C("event_id").alias("place"), F.when(C("event_id") % 2 == 0, "approve").otherwise("reject").alias("action"))
    return curation.review(_candidates(spark, sf_dir), commands)


@register("c3_review_succeeded", f"{_REVIEW} SELECT id, done AS status FROM r WHERE error IS NULL")
def c3(spark, sf_dir):
    return _review(spark, sf_dir)[0]


@register("c3_review_failed", f"{_REVIEW} SELECT id, place, error FROM r WHERE error IS NOT NULL")
def c3f(spark, sf_dir):
    return _review(spark, sf_dir)[1]


@register("c5_promoted_payload", "SELECT event_id AS id, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k'), json_extract_string(props, '$.page'), 'unnamed') AS name, 'concept' AS entity_type FROM events")
def c5(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(C("event_id").alias("id"), C("props").alias("payload"))
    return curation.promoted(events, {"name": (["name", "k", "page"], "unnamed"), "entity_type": (["no_such_key"], "concept")})


@register("a17_review_groups", f"""WITH {mapping.OBSERVATIONS_SQL} SELECT CAST(valid_from AS DATE) AS day, source_type AS label, count(*) AS items, count(*) FILTER (id % 4 <> 0) AS pending,
  count(*) FILTER (confidence < 0.45 OR (confidence < 0.65 AND id % 2 = 0) OR length(content) < 16) AS noisy FROM observations GROUP BY ALL""")
def a17(spark, sf_dir):
    c = _candidates(spark, sf_dir).withColumn("label", C("source_type")).withColumn("evidence_count", C("id") % 2)
    return curation.review_groups(c)


# evaluation


def _run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", C("source").alias("qid"), "n_chars")
    qrels = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("qid", C("doc_id").alias("id"), (C("quality") + C("toxic")).alias("grade"))
    run = top(docs, ["qid"], [C("n_chars").desc(), C("doc_id")], 20).select("qid", C("doc_id").alias("id"), "rank")
    return run, qrels


_EVAL = """WITH d AS (SELECT doc_id AS id, source AS qid, n_chars FROM documents), q AS (SELECT qid, id, quality + toxic AS grade FROM d JOIN labels l ON l.doc_id = d.id),
  r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY n_chars DESC, id) AS rank FROM d QUALIFY rank <= 20),
  j AS (SELECT r.qid, rank, grade, coalesce(grade, 0) AS g, (coalesce(grade, 0) > 0)::INT AS rel, sum((coalesce(grade, 0) > 0)::INT) OVER (PARTITION BY r.qid ORDER BY rank) AS hits FROM r LEFT JOIN q USING (qid, id)),
  i AS (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS rank FROM q),
  b AS (SELECT qid, {ideal}, count(*) FILTER (grade > 0) AS n FROM i GROUP BY qid),
  m AS (SELECT qid, {got}, {rel}, min(rank) FILTER (rel = 1) AS f, sum(rel * hits / rank) AS ap, count(*) FILTER (rank <= 10 AND grade IS NOT NULL) AS jd, least(max(rank), 10) AS ten FROM j GROUP BY qid),
  e AS (SELECT qid, {ndcg}, {recall}, round(coalesce(r5, 0) / 5, 6) AS precision_5, round(coalesce(r10, 0) / 10, 6) AS precision_10, (coalesce(r1, 0) > 0)::INT::DOUBLE AS success_1, (coalesce(r5, 0) > 0)::INT::DOUBLE AS success_5,
    round(coalesce(1.0 / f, 0), 6)::DOUBLE AS mrr, round(CASE WHEN n > 0 THEN coalesce(ap, 0) / n ELSE 0 END, 6)::DOUBLE AS map, round(coalesce(jd / ten, 0), 6)::DOUBLE AS judged_10 FROM b LEFT JOIN m USING (qid))""".format(
    ideal=", ".join(f"sum(CASE WHEN rank <= {k} THEN grade / log2(rank + 1) ELSE 0 END) AS i{k}" for k in (1, 3, 5, 10)), got=", ".join(f"sum(CASE WHEN rank <= {k} THEN g / log2(rank + 1) ELSE 0 END) AS d{k}" for k in (1, 3, 5, 10)),
    rel=", ".join(f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END) AS r{k}" for k in (1, 5, 10, 20)), ndcg=", ".join(f"round(CASE WHEN i{k} > 0 THEN coalesce(d{k}, 0) / i{k} ELSE 0 END, 6)::DOUBLE AS ndcg_{k}" for k in (1, 3, 5, 10)),
    recall=", ".join(f"round(CASE WHEN n > 0 THEN coalesce(r{k}, 0) / n ELSE 0 END, 6)::DOUBLE AS recall_{k}" for k in (5, 10, 20)),
)


@register("e1_e3_metrics", f"{_EVAL} SELECT * FROM e")
def e1(spark, sf_dir):
    return evaluate.metrics(*_run(spark, sf_dir))


@register("e4_macro", f"{_EVAL} SELECT metric, ((2 * sum(CAST(round(value * 1000000) AS BIGINT)) + count(value)) // (2 * count(value)))::DOUBLE / 1000000 AS value FROM (UNPIVOT (SELECT * EXCLUDE (qid) FROM e) ON COLUMNS(*) INTO NAME metric VALUE value) GROUP BY metric")
def e4(spark, sf_dir):
    return evaluate.macro(evaluate.metrics(*_run(spark, sf_dir)))


@register("a12_confusion", """SELECT lang, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6)::DOUBLE AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6)::DOUBLE AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)::DOUBLE AS f1 FROM (
  SELECT lang, count(*) FILTER (quality = 1 AND n_chars > 500) AS tp, count(*) FILTER (quality = 0 AND n_chars > 500) AS fp, count(*) FILTER (quality = 1 AND n_chars <= 500) AS fn, count(*) FILTER (quality = 0 AND n_chars <= 500) AS tn FROM documents JOIN labels USING (doc_id) GROUP BY lang)""")
def a12(spark, sf_dir):
    pairs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", (C("quality") == 1).alias("expected"), (C("n_chars") > 500).alias("found"))
    return evaluate.confusion(pairs, ["lang"])


@register("e7_holm", """WITH t AS (SELECT source AS family, doc_id::VARCHAR AS name, (n_chars % 997) / 997.0::DOUBLE AS p FROM documents), s AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1) * p) AS a FROM t)
  SELECT family, name, p, round(max(a) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM s""")
def e7(spark, sf_dir):
    return evaluate.holm(table(spark, sf_dir, "documents").select(C("source").alias("family"), C("doc_id").cast("string").alias("name"), ((C("n_chars") % 997) / 997.0).alias("p")))


@register("e10_gate", "SELECT source AS metric, 0.8::DOUBLE AS floor, v AS value FROM (SELECT source, round(avg(quality), 6) AS v FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) WHERE v IS NULL OR v < 0.8")
def e10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy(C("source").alias("metric")).agg(F.round(F.avg("quality"), 6).alias("value"))
    return evaluate.gate(found, docs.select(C("source").alias("metric"), F.lit(0.8).alias("floor")).distinct())


@register("e5_bootstrap")
def e5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return evaluate.bootstrap(docs.groupBy(C("lang").alias("name"), C("source").alias("qid")).agg(F.avg("quality").alias("x")), resamples=2000)
