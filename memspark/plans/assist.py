"""Composed plans: the search dispatcher, cited answers, handoffs, and bundles."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import scoring, text
from memspark.operators import evidence, listing, search
from memspark.operators.changes import emitted, first_of
from memspark.operators.postings import BROADCAST_ROWS
from memspark.operators.stored import stored


NO_SEMANTIC, NO_SCORER = "no semantic result: keyword order", "no reranker: fused order"


def find(
    queries: DataFrame, records: DataFrame, mode: str = "hybrid", k: int = 10, dim: int = 64, *, vectors: DataFrame | None = None, owned: DataFrame | None = None,
    edges: DataFrame | None = None, temporal: DataFrame | None = None, scorer: Column | None = None, stem: bool = False,
    words: DataFrame | None = None, near: DataFrame | None = None,
) -> DataFrame:
    """qid, id, score, rank, fallback of ``queries`` (qid, query) over ``records`` (id, title, content).

    Modes: keyword, semantic (hashed vectors), hybrid (both fused), graph (a third arm: records of the entities near the
    owners of the keyword hits, by ``owned`` (id, entity_id) and ``edges``), rerank (the fused pool in the order of ``scorer``).
    A query whose semantic arm finds nothing falls back to keywords, and says so; so does rerank without a scorer. All but
    keyword and semantic take three times as many from each arm, 100 at most. ``k`` is held from 1 to 100. ``temporal``
    (id, boost) is added once to a fused score. Stored ``vectors`` (id, v) of the records save embedding them; stored
    results of the two arms, ``words`` and ``near`` (qid, id, score, rank), at least as deep as is needed here, save the searches.
    """
    k = min(max(k, 1), 100)
    pool = k if mode in ("keyword", "semantic") else min(3 * k, 100)
    content = records.select("id", "content")
    searched = lambda asked: stored(search.keyword_search(asked, content, pool, stem=stem), "keyword_arm")
    if words is not None:
        words = words.where(F.col("rank") <= pool)
    elif mode != "semantic":
        words = searched(queries)
    if mode == "keyword":
        return words.withColumn("fallback", F.lit(None).cast("string"))
    near = semantic_arm(queries, content, pool, dim, vectors) if near is None else near.where(F.col("rank") <= pool)
    found = near.select("qid").distinct().withColumn("_semantic", F.lit(True))
    if mode == "semantic":
        near = near.withColumn("fallback", F.lit(None).cast("string"))
        lost = stored(queries.join(found, "qid", "left_anti"), "lost")
        if not lost.limit(1).count():
            return near
        rest = searched(lost) if words is None else words.join(lost, "qid", "left_semi")
        return near.unionByName(rest.withColumn("fallback", F.lit(NO_SEMANTIC)))
    arm = lambda found, name: found.select("qid", F.lit(name).alias("arm"), "id", "rank")
    arms = arm(words, "keyword").unionByName(arm(near, "semantic"))
    if mode == "graph":
        arms = stored(arms.unionByName(arm(evidence.graph_arm(words.select("qid", "id", "rank"), owned, edges, pool), "graph")), "arms")
    # a pair's texts are looked at once, whichever arms have it
    pairs = stored(arms.select("qid", "id").distinct(), "pairs")
    pairs = pairs.join(queries, "qid").join(named(records.select("id", "title", "content"), pairs), "id")
    pairs = pairs.select("qid", "id", scoring.text_boost(F.col("query"), F.col("title"), F.col("content")).alias("boost"))
    arms = arms.join(pairs, ["qid", "id"])
    fused = search.fuse(arms, pool if mode == "rerank" or temporal is not None else k)
    if temporal is not None:
        later = fused.join(temporal.select("id", F.col("boost").alias("_boost")), "id", "left").withColumn("score", F.round(F.col("score") + F.coalesce("_boost", F.lit(0.0)), 6))
        fused = search.top(later.drop("_boost", "rank"), ["qid"], [F.col("score").desc(), F.col("best_rank"), F.col("id")], pool)
    if mode == "rerank" and scorer is not None:
        fused = rerank(fused, queries, records, scorer, k)
    note = F.when(F.col("_semantic").isNull(), NO_SEMANTIC)
    note = note.otherwise(NO_SCORER) if mode == "rerank" and scorer is None else note
    return fused.where(F.col("rank") <= k).join(found, "qid", "left").select("qid", "id", "score", "rank", note.alias("fallback"))


def semantic_arm(queries: DataFrame, content: DataFrame, pool: int, dim: int = 64, vectors: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank, stored: the ``pool`` records (id, content) whose hashed vectors are nearest to those of ``queries`` (qid, query)."""
    asked = search.hash_embedding(queries.select(F.col("qid").alias("id"), F.col("query").alias("content")), dim).select(F.col("id").alias("qid"), F.col("v").alias("q"))
    return stored(search.vector_search(asked, search.hash_embedding(content, dim) if vectors is None else vectors, pool), "semantic_arm")


def named(records: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``records`` (id, ...) that ``found`` (id) names, stored: where these are few, the other records aren't shuffled."""
    ids = stored(found.select("id").distinct(), "ids")
    few = ids.count() <= BROADCAST_ROWS
    return stored(records.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "named")


def rerank(found: DataFrame, queries: DataFrame, records: DataFrame, scorer: Column | None = None, k: int = 10) -> DataFrame:
    """``found`` (qid, id) in the order of a scorer of the columns query, title and content: a Column, such as a pandas UDF of a model.

    Without one, the text boost is the score. Scores pass through the logistic function.
    """
    found = stored(found.select("qid", "id"), "found")
    rows = found.join(queries, "qid").join(named(records.select("id", "title", "content"), found), "id")
    raw = scorer if scorer is not None else scoring.text_boost(F.col("query"), F.col("title"), F.col("content"))
    rows = rows.select("qid", "id", F.round(1 / (1 + F.exp(-raw)), 6).alias("score"))
    return search.top(rows, ["qid"], [F.col("score").desc(), F.col("id")], k)


def ask(queries: DataFrame, records: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(answers: qid, answer; audit: qid, question, returned_ids, retrieval_mode) of hybrid search with citations."""
    found = stored(find(queries, records, "hybrid", k), "found")
    found = found.join(named(records.select("id", "title"), found), "id")
    line = F.struct("rank", F.format_string("[%d] %s (%s)", "rank", "title", F.col("id").cast("string")).alias("line"), "id")
    per = found.groupBy("qid").agg(F.array_sort(F.collect_list(line)).alias("_l"))
    both = queries.join(per, "qid", "left")
    text = F.when(F.col("_l").isNull(), "Nothing is known about this.").otherwise(F.concat(F.lit("Known:\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n")))
    audit = both.select("qid", F.col("query").alias("question"), F.transform("_l", lambda x: x["id"]).alias("returned_ids"), F.lit("hybrid").alias("retrieval_mode"))
    return both.select("qid", text.alias("answer")), audit


def handoffs(sessions: DataFrame, decisions: DataFrame, state: DataFrame, k: int = 10) -> DataFrame:
    """id, context for ended ``sessions`` (id, goal, scope): goal, latest ``decisions`` (decided_in, title, created_at) and active ``state`` (scope, title)."""
    latest = search.top(decisions, ["decided_in"], [F.col("created_at").desc(), F.col("title")], k)
    made = latest.groupBy(F.col("decided_in").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: F.concat(F.lit("- "), x["title"])), "\n").alias("_d"))
    open_ = state.groupBy("scope").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "title"))), "\n").alias("_s"))
    out = sessions.join(made, "id", "left").join(open_, "scope", "left")
    none = F.lit("- none")
    return out.select("id", F.concat(F.lit("Goal: "), "goal", F.lit("\nDecisions:\n"), F.coalesce("_d", none), F.lit("\nState:\n"), F.coalesce("_s", none)).alias("context"))


#: The most pending candidates that an answer counts.
PENDING = 200


def scoped_answers(questions: DataFrame, found: DataFrame, sections: dict[str, tuple[DataFrame, Column, list[Column], int]], candidates: DataFrame, evidence: DataFrame, k: int = 5) -> dict[str, DataFrame]:
    """``answers`` (qid, answer), ``audit`` (qid, agent, question, scope, returned_ids) and those ``rejected`` (qid, error) of ``questions`` (qid, query, scope, agent).

    An answer holds what the question's scope sees: a line for each of ``sections`` (title: records, line, order, k) that has records, the first ``k``
    of what was ``found`` (qid, id, record_type, title, scope, snippet, rank) with two pieces of ``evidence`` (id, created_at, uri) each, and how many
    ``candidates`` (scope, status) are pending, ``PENDING`` at most. The first 20 that were found, which is what a question may ask for, are audited as type:id. An empty question is
    rejected, an empty agent is unknown. Scopes are briefed once, however many questions have them, and counted by scope before they are joined.
    """
    asked = questions.withColumn("query", F.trim("query"))
    empty = F.coalesce(F.col("query"), F.lit("")) == ""
    rejected = asked.where(empty).select("qid", F.lit("question is required").alias("error"))
    asked = stored(asked.where(~empty).withColumns({"scope": F.coalesce("scope", F.lit("")), "agent": F.coalesce(F.nullif(F.trim("agent"), F.lit("")), F.lit("unknown"))}), "asked")
    scopes = asked.select(F.col("scope").alias("query_scope")).distinct()
    in_order = lambda by: F.transform(F.array_sort(F.collect_list(F.struct(by, "line"))), lambda x: x["line"])
    out = asked
    for i, (title, (records, line, order, most)) in enumerate(sections.items()):
        seen = listing.list_records(scopes, records, order, most).select(F.col("query_scope").alias("scope"), "rank", line.alias("line"))
        per = seen.groupBy("scope").agg(F.concat(F.lit(f"{title}: "), F.array_join(in_order("rank"), "; "), F.lit(".")).alias(f"_section{i}"))
        out = out.join(per, "scope", "left")
    waiting = listing.counts(scopes, {"pending": candidates.where("status = 'pending'")})
    out = out.join(waiting.select(F.col("query_scope").alias("scope"), F.least("pending", F.lit(PENDING)).alias("_pending")), "scope", "left")

    shown = search.top(found.join(asked.select("qid"), "qid", "left_semi"), ["qid"], [F.col("rank"), F.col("id")], 20, "_place")  # a question asks for 20 at most
    first = search.top(evidence.join(shown.where(F.col("_place") <= k).select("id").distinct(), "id", "left_semi"), ["id"], [F.col("created_at"), F.col("uri")], 2, "_n")
    proof = first.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "uri"))), lambda x: x["uri"]), ", ").alias("_proof"))
    lines = F.concat(F.lit("- ["), "record_type", F.lit("] "), "title", F.lit(" ("), text.display_scope(F.col("scope")), F.lit(") — "), "snippet", F.lit(" Evidence: "), F.coalesce("_proof", F.lit("no evidence link")))
    cited = shown.where(F.col("_place") <= k).join(proof, "id", "left").select("qid", "_place", lines.alias("line")).groupBy("qid").agg(F.concat(F.lit("Most relevant:\n"), F.array_join(in_order("_place"), "\n")).alias("_cited"))
    ids = shown.select("qid", "_place", F.concat("record_type", F.lit(":"), F.col("id").cast("string")).alias("line")).groupBy("qid").agg(in_order("_place").alias("returned_ids"))
    out = out.join(cited, "qid", "left").join(ids, "qid", "left")
    parts = [f"_section{i}" for i in range(len(sections))] + ["_cited"]
    nothing = F.when(F.coalesce(*parts).isNull(), F.lit("Nothing is known about this."))
    pending = F.when(F.col("_pending") > 0, F.format_string("Pending review: %d.", "_pending"))
    answer = F.concat_ws("\n", F.concat(F.lit("Asked: "), "query"), nothing, *parts, pending)
    audit = out.select("qid", "agent", F.col("query").alias("question"), "scope", F.coalesce("returned_ids", F.array().cast("array<string>")).alias("returned_ids"))
    return {"answers": out.select("qid", answer.alias("answer")), "audit": audit, "rejected": rejected}


# Lines of a handoff's text.
NOTHING, NO_GOAL = "- None recorded.", "No goal recorded"
HANDOFF_ENDS = "Start from the remaining items and verify current repository state before editing."


def _section(title: str, lines: Column) -> Column:
    """A section of a handoff's text: its title, and its lines or the note that there are none; ``lines`` may be null."""
    return F.concat(F.lit(f"\n## {title}\n"), F.coalesce(F.nullif(lines, F.lit("")), F.lit(NOTHING)), F.lit("\n"))


def hand_off(sessions: DataFrame, asked: DataFrame, decisions: DataFrame, state: DataFrame, at: Column, k: int = 10) -> dict[str, DataFrame]:
    """``sessions`` after the handoffs that are ``asked``, the new ``events``, the ``contexts`` (id, child_session, context), and what was ``rejected`` (place, error).

    ``asked`` (place, project, id) names a session, or with a null id the latest active one of its project. A session
    that is handed off is closed and names its child, which goes on with its type, project, scope and goal; ids of children
    are hashes of the parent's, so reruns agree. A session that is asked for several times, by id or as the latest, is handed
    off once, for the smallest place. Rejected: ids that don't exist or aren't active, projects without an active session.

    ``sessions``: id, session_type, project, scope, goal, status, parent_session, child_session, handoff_context, started_at, ended_at,
    summary, and the arrays accomplishments, remaining and files_changed, which may be null. The text has the ``k`` latest
    ``decisions`` (id, decided_in, title, created_at) of the session and the first ``k`` of the open ``state`` (key, scope, title, status,
    updated_at) that its scope sees. Each scope's state is cut before scopes that see it are joined.
    """
    active = sessions.where("status = 'active'")
    latest = first_of(active, ["project"], [F.col("started_at").desc_nulls_last(), F.col("id").desc()]).select("project", F.col("id").alias("_latest"))
    wanted = asked.select("place", "project", "id").join(latest, "project", "left").select("place", F.coalesce("id", "_latest").alias("id"))
    known = sessions.select("id", F.col("status").alias("_status"))
    wanted = stored(wanted.join(known, "id", "left"), "asked")
    error = F.when(F.col("id").isNull(), "no active session").when(F.col("_status").isNull(), "not found").when(F.col("_status") != "active", F.concat(F.lit("already "), "_status"))
    rejected = wanted.select("place", error.alias("error")).where("error IS NOT NULL")
    parents = sessions.join(wanted.where("_status = 'active'").select("id").distinct(), "id", "left_semi")
    child = F.substring(F.sha2(F.concat_ws("\u001f", F.lit("handoff"), "id"), 256), 1, 26)

    joined = lambda rows, by: rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(F.lit("- "), x["line"])), "\n").alias("_lines"))
    made = decisions.join(parents.select(F.col("id").alias("decided_in")), "decided_in", "left_semi")
    made = search.top(made, ["decided_in"], [F.col("created_at").desc_nulls_last(), F.col("id").desc(), F.col("title")], k).withColumn("line", F.concat("id", F.lit(": "), "title"))
    made = joined(made, "decided_in").select(F.col("decided_in").alias("id"), F.col("_lines").alias("_decisions"))
    seen = listing.list_records(parents.select(F.col("scope").alias("query_scope")).distinct(), state, [F.col("updated_at").desc_nulls_last(), F.col("key")], k)
    seen = joined(seen.withColumn("line", F.format_string("%s: %s [%s]", "key", "title", "status")), "query_scope")
    both = parents.join(made, "id", "left").join(seen.select(F.col("query_scope").alias("scope"), F.col("_lines").alias("_state")), "scope", "left")
    items = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    head = {"Parent session": F.col("id"), "Tool": F.col("session_type"), "Project": F.col("project"), "Scope": text.display_scope(F.col("scope")), "Goal": F.coalesce("goal", F.lit(NO_GOAL))}
    context = F.concat(
        F.lit("# Handoff\n\n"), *[F.concat(F.lit(f"- {name}: "), F.coalesce(value, F.lit("")), F.lit("\n")) for name, value in head.items()],
        _section("Summary", F.trim("summary")), _section("Accomplishments", items("accomplishments")), _section("Remaining", items("remaining")),
        _section("Files Changed", items("files_changed")), _section("Decisions Made", F.col("_decisions")), _section("Relevant Active Work", F.col("_state")),
        F.lit(f"\n{HANDOFF_ENDS}\n"),
    )
    given = both.select("id", "session_type", "project", "scope", "goal", child.alias("child_session"), context.alias("context"))
    given = stored(given, "handoffs")
    closed = sessions.join(given.select("id", F.col("child_session").alias("_child"), F.col("context").alias("_context")), "id", "left")
    ends = {"status": F.lit("handed-off"), "child_session": F.col("_child"), "handoff_context": F.col("_context"), "ended_at": at}
    closed = closed.withColumns({c: F.when(F.col("_child").isNotNull(), new).otherwise(F.col(c)) for c, new in ends.items()}).select(*sessions.columns)
    opened = given.select(F.col("child_session").alias("id"), "session_type", "project", "scope", "goal", F.lit("active").alias("status"), F.col("id").alias("parent_session"), at.alias("started_at"))
    event = lambda kind, target: emitted(given, F.lit(kind), F.col(target), at)
    return {
        "sessions": closed.unionByName(opened, allowMissingColumns=True), "events": event("session_handoff", "id").unionByName(event("session_started", "child_session")),
        "contexts": given.select("id", "child_session", "context"), "rejected": rejected,
    }


def lineage(sessions: DataFrame) -> DataFrame:
    """id, root, depth along parent_session, by doubling the distance that each step jumps."""
    hop = stored(sessions.select("id", F.coalesce("parent_session", "id").alias("root"), F.col("parent_session").isNotNull().cast("long").alias("depth")), "lineage")
    while True:
        far = hop.select(F.col("id").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        new = hop.join(far, "root", "left").select("id", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("_depth") > 0).alias("_more"))
        new = stored(new, "lineage")
        hop = new.drop("_more")
        if not new.where("_more").limit(1).count():
            return hop


def export_bundle(tables: dict[str, tuple[DataFrame, list[str]]], path: str) -> None:
    """Writes each table's rows, in order of its columns, as JSON under ``path``/name."""
    for name, (rows, order) in tables.items():
        rows.orderBy(*order).write.mode("overwrite").json(f"{path}/{name}")


class Live(NamedTuple):
    """A table of a snapshot: its rows, the condition of live ones, its order, and whose scope its rows have: their own (column scope), or that of a parent (column, table)."""

    rows: DataFrame
    live: Column | None = None
    order: tuple[str, ...] = ("id",)
    of: tuple[tuple[str, str], ...] = ()


def snapshot(tables: dict[str, Live], scopes: DataFrame) -> dict[str, tuple[DataFrame, list[str]]]:
    """The live rows of ``tables`` that lie in ``scopes`` (scope), for ``export_bundle``; tables stand after those that their rows' scope comes from.

    A row without a scope of its own comes with its parents: all that ``of`` names must be in the snapshot.
    """
    out: dict[str, tuple[DataFrame, list[str]]] = {}
    for name, t in tables.items():
        rows = t.rows if t.live is None else t.rows.where(t.live)
        if not t.of:
            rows = rows.join(scopes.select("scope").distinct(), "scope", "left_semi")
        for column, parent in t.of:
            rows = rows.join(out[parent][0].select(F.col("id").alias(column)).distinct(), column, "left_semi")
        out[name] = rows.select(*t.rows.columns), list(t.order)
    return out


class Merge(NamedTuple):
    """How a table of a bundle comes in: its key, what becomes of known keys (keep, replace, or newer by ``order``), and the parents that a row needs (column, table)."""

    key: str
    policy: str
    order: str | None = None
    parents: tuple[tuple[str, str], ...] = ()


def _rooted(rows: DataFrame, there: DataFrame) -> DataFrame:
    """key, ok of ``rows`` (key, parent, lost): whether the chain of parents ends at a row that needs none or at one of ``there`` (id), and not in a cycle or at a lost row.

    Steps double in length, so a chain takes as many rounds as its length has binary digits.
    """
    ids = there.select(F.col("id").alias("_id"), F.lit(True).alias("_there")).distinct()
    keys = rows.select(F.col("key").alias("_key"), F.lit(True).alias("_comes"))
    both = rows.join(ids, F.col("parent") == F.col("_id"), "left").join(keys, F.col("parent") == F.col("_key"), "left")
    ends = F.when(F.col("lost"), False).when(F.col("parent").isNull() | F.col("_there").isNotNull(), True).when(F.col("_comes").isNull(), False)
    state = stored(both.select("key", F.when(ends.isNull(), F.col("parent")).alias("to"), ends.alias("ok")), "chains")
    for _ in range(state.where("ok IS NULL").count().bit_length() + 1):
        if not state.where("ok IS NULL").limit(1).count():
            break
        further = state.select(F.col("key").alias("to"), F.col("to").alias("_to"), F.col("ok").alias("_ok"))
        moved = state.where("ok IS NULL").join(further, "to").select("key", F.col("_to").alias("to"), F.col("_ok").alias("ok"))
        state = stored(state.where("ok IS NOT NULL").unionByName(moved), "chains")
    return state.select("key", F.coalesce("ok", F.lit(False)).alias("ok"))


def merge_bundle(base: dict[str, DataFrame], incoming: dict[str, DataFrame], rules: dict[str, Merge]) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables with a bundle's rows merged in; report: table, outcome, n), in the order of ``rules``: parents stand before children.

    Outcomes: inserted, replaced, kept (what stood there stays) and orphan (a parent is neither there nor among the rows of the bundle that come
    in). A table may be its own parent in one column: chains within a bundle come in, cycles and what hangs on a lost row don't.
    A row without parent id needs none. Of several incoming rows of a key the last by ``order`` counts, or by its values.
    """
    merged, report = dict(base), None
    for name, rule in rules.items():
        old = base[name]
        order = [F.col(rule.order).desc_nulls_last()] if rule.order else []
        new = first_of(incoming[name].select(*old.columns), [rule.key], [*order, *[F.col(c).desc_nulls_last() for c in sorted(old.columns)]])
        marked = new.withColumn("_orphan", F.lit(False))
        own = [column for column, parent in rule.parents if parent == name]
        if len(own) > 1:
            raise ValueError(f"{name} has several parents among its own rows")
        for column, parent in rule.parents:
            if parent == name:
                continue
            ids = merged[parent].select(F.col(rules[parent].key).alias("_parent"), F.lit(True).alias("_there")).distinct()
            marked = marked.join(ids, F.col(column) == F.col("_parent"), "left").withColumn("_orphan", F.col("_orphan") | (F.col(column).isNotNull() & F.col("_there").isNull())).drop("_parent", "_there")
        if own:  # parents that come in the same bundle count, if they come in themselves
            marked = stored(marked, "incoming")
            chains = marked.select(F.col(rule.key).alias("key"), F.col(own[0]).alias("parent"), F.col("_orphan").alias("lost"))
            rooted = _rooted(chains, old.select(F.col(rule.key).alias("id"))).select(F.col("key").alias("_key"), "ok")
            marked = marked.join(rooted, F.col(rule.key) == F.col("_key"), "left").withColumn("_orphan", ~F.coalesce("ok", F.lit(False))).drop("_key", "ok")
        was = old.select(F.col(rule.key).alias("_key"), F.col(rule.order or rule.key).alias("_was"))
        marked = marked.join(was, F.col(rule.key) == F.col("_key"), "left")
        wins = {"keep": F.lit(False), "replace": F.lit(True), "newer": F.col(rule.order) > F.col("_was") if rule.order else F.lit(False)}[rule.policy]
        outcome = F.when(F.col("_orphan"), "orphan").when(F.col("_key").isNull(), "inserted").when(F.coalesce(wins, F.lit(False)), "replaced").otherwise("kept")
        marked = stored(marked.withColumn("_outcome", outcome), "merged")
        comes = marked.where("_outcome IN ('inserted', 'replaced')").select(*old.columns)
        merged[name] = old.join(comes.select(rule.key), rule.key, "left_anti").select(*old.columns).unionByName(comes)
        one = marked.groupBy(F.col("_outcome").alias("outcome")).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "outcome", "n")
        report = one if report is None else report.unionByName(one)
    return merged, report


def import_children(rows: DataFrame, parents: DataFrame, foreign: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``foreign`` key is among ``parents`` (id), the orphans)."""
    ids = parents.select(F.col("id").alias(foreign)).distinct()
    return rows.join(ids, foreign, "left_semi"), rows.join(ids, foreign, "left_anti")
