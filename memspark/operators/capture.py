"""Capture: events of files, sessions for events, summaries as candidates, imports with a budget, and the capture status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text
from memspark.operators.changes import first_of
from memspark.operators.evidence import ignored
from memspark.operators.search import top
from memspark.sources.transcripts import blocked

SUMMARY_LINES, LINE_CHARACTERS, EXCERPT_CHARACTERS = 30, 360, 420
RECENT_EVENTS = 20
UNREVIEWED = "Made from captured events; review before trusting."


def file_events(files: DataFrame, blocks: DataFrame, scope: Column) -> DataFrame:
    """Capture events (scope, source_type, source, title, text) of changed ``files`` (path, content), those in ignored folders or under ``blocks`` left out."""
    kept = blocked(files.where(~ignored(F.col("path"))), blocks)
    title = F.concat(F.lit("File changed: "), F.element_at(F.split("path", "/"), -1))
    return kept.select(scope.alias("scope"), F.lit("file").alias("source_type"), F.col("path").alias("source"), title.alias("title"), text.capped(F.col("content")).alias("text"))


def attach_sessions(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """``events`` (project, scope, ...) with capture_session: the latest active one of ``sessions`` (id, project, scope, status, started_at) of its project and scope.

    Where there is none, all events of that project and scope open the same one, whose id is a hash of both. ``events``
    may be a stream.
    """
    active = first_of(sessions.where("status = 'active'"), ["project", "scope"], [F.col("started_at").desc(), F.col("id").desc()])
    active = active.select("project", "scope", F.col("id").alias("_session"))
    new = F.substring(F.sha2(F.concat_ws("\u001f", F.lit("capture"), "project", "scope"), 256), 1, 26)
    return events.join(active, ["project", "scope"], "left").withColumn("capture_session", F.coalesce("_session", new)).drop("_session")


def summaries(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, evidence) that sum up ``events`` (id, capture_session, scope, source_type, title, text, captured_at) of each capture session.

    A session gives a context and a state candidate over its newest SUMMARY_LINES events; older ones are counted. Only these
    lines are collected, so a long session is no large row.
    """
    recent = top(events, ["capture_session"], [F.col("captured_at").desc(), F.col("id").desc()], SUMMARY_LINES)
    said = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", text.compact(F.col("text"), LINE_CHARACTERS)).otherwise("No event text.")
    name = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise("Untitled event")
    line = F.format_string("- [%s] %s at %s: %s", "source_type", name, F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), said)
    shown = recent.withColumn("_line", line).groupBy("capture_session").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_line"))), lambda x: x["_line"]), "\n").alias("_lines"),
        F.max_by(F.col("id").cast("string"), -F.col("rank")).alias("_newest"), F.max_by("scope", -F.col("rank")).alias("scope"),
    )
    mix = events.groupBy("capture_session", "source_type").agg(F.count("*").alias("n"))
    mix = mix.groupBy("capture_session").agg(F.sum("n").alias("_n"), F.array_join(F.array_sort(F.collect_list(F.concat("source_type", F.lit(": "), F.col("n").cast("string")))), ", ").alias("_mix"))
    more = F.when(F.col("_n") > SUMMARY_LINES, F.format_string("\n- ... %d more events", F.col("_n") - SUMMARY_LINES)).otherwise("")
    # fixed values: the wording of a summary, which must be the same wherever it is written
    content = F.concat(F.format_string("Automatic coding capture summary.\nCaptured events summarized: %d\nSource mix: %s\n\nRecent captured evidence:\n", "_n", "_mix"), "_lines", more)
    both = shown.join(mix, "capture_session").withColumn("_content", content)
    key = lambda prefix: F.concat(F.lit(prefix), "_newest")
    context = F.to_json(F.struct(key("capture-summary-").alias("key"), F.lit("Automatic coding capture summary").alias("title"), F.lit("audit").alias("category"), F.col("_content").alias("content")))
    state = F.to_json(F.struct(key("capture-review-").alias("key"), F.lit("Review automatic coding capture").alias("title"), F.lit("needs-review").alias("status"), F.lit("medium").alias("priority"), F.col("_content").alias("details")))
    made = lambda kind, payload, confidence: F.struct(F.lit(kind).alias("record_type"), payload.alias("payload"), F.lit(confidence).alias("confidence"))
    rows = both.select("capture_session", "scope", F.explode(F.array(made("context", context, 0.7), made("state", state, 0.64))).alias("c"))
    identity = F.concat_ws(":", "capture_session", "c.record_type")
    candidates = rows.select(
        identity.alias("id"), F.lit("capture:auto").alias("source_type"), F.col("capture_session").cast("string").alias("source"), "c.record_type", "c.payload", "scope", "c.confidence", F.lit(UNREVIEWED).alias("rationale")
    )
    excerpt = F.when(F.trim(F.coalesce("text", F.lit(""))) != "", text.compact(F.col("text"), EXCERPT_CHARACTERS)).otherwise(F.coalesce("title", F.lit("Captured event")))
    kinds = F.explode(F.array(F.lit("context"), F.lit("state"))).alias("_kind")
    evidence = recent.select(F.col("id").alias("source_event_id"), "source_type", "title", excerpt.alias("excerpt"), "captured_at", "capture_session", kinds)
    return candidates, evidence.withColumn("candidate_id", F.concat_ws(":", "capture_session", "_kind")).drop("_kind", "capture_session")


def working_tree_candidates(status: DataFrame, scope: Column) -> DataFrame:
    """Context and state candidates of each snapshot of ``status`` (id, changed, staged, unstaged, untracked: arrays), those without a change left out."""
    part = lambda name: F.format_string(f"{name.capitalize()}: %d%s", F.size(name), F.when(F.size(name) > 0, F.concat(F.lit(" ("), F.array_join(F.slice(name, 1, 12), ", "), F.lit(")"))).otherwise(""))
    content = F.concat_ws("\n", F.lit("Working tree snapshot."), *[part(n) for n in ("changed", "staged", "unstaged", "untracked")])
    rows = status.where(F.size("changed") > 0).withColumn("_content", content)
    key = lambda prefix: F.concat(F.lit(prefix), F.col("id").cast("string"))
    context = F.to_json(F.struct(key("worktree-").alias("key"), F.lit("Working tree snapshot").alias("title"), F.lit("audit").alias("category"), F.col("_content").alias("content")))
    state = F.to_json(F.struct(key("worktree-review-").alias("key"), F.lit("Review working tree changes").alias("title"), F.lit("in-progress").alias("status"), F.lit("medium").alias("priority"), F.col("_content").alias("details")))
    made = lambda kind, payload, confidence: F.struct(F.lit(kind).alias("record_type"), payload.alias("payload"), F.lit(confidence).alias("confidence"))
    rows = rows.select("id", F.explode(F.array(made("context", context, 0.72), made("state", state, 0.66))).alias("c"))
    return rows.select(F.concat_ws(":", F.col("id").cast("string"), "c.record_type").alias("id"), F.lit("capture:git").alias("source_type"), scope.alias("scope"), "c.record_type", "c.payload", "c.confidence")


def import_documents(files: DataFrame, candidates: DataFrame, source_type: str = "import") -> DataFrame:
    """Pending context candidates of ``files`` (path, content) that aren't empty and whose (source_type, source) ``candidates`` don't have yet."""
    known = candidates.where(F.col("source_type") == source_type).select(F.col("source").alias("path")).distinct()
    new = files.where(F.trim(F.coalesce("content", F.lit(""))) != "").join(known, "path", "left_anti")
    title = F.element_at(F.split("path", "/"), -1)
    payload = F.to_json(F.struct(text.slugify(F.col("path")).alias("key"), title.alias("title"), F.lit("reference").alias("category"), text.capped(F.trim("content")).alias("content")))
    return new.select(
        F.substring(F.sha2(F.concat_ws("\u001f", F.lit(source_type), "path"), 256), 1, 26).alias("id"), F.lit(source_type).alias("source_type"), F.col("path").alias("source"), F.lit("context").alias("record_type"),
        payload.alias("payload"), F.lit(0.6).alias("confidence"), F.lit("pending").alias("status"), text.compact(F.col("content"), 800).alias("excerpt"),
    )


def import_events(parsed: DataFrame, known: DataFrame, key: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(events to add, outcome of each source) of ``parsed`` transcript events (source, idx, ...) under a budget of ``limit`` new events.

    Sources count in order of name, events in order of idx. An event whose ``key`` ``known`` has, or an earlier event of the
    batch, is a duplicate and costs no budget. Outcome: source, events, duplicates, imported, skipped (why none came in).
    The running count is made of counts of sources, so only one source's events stand in one window.
    """
    marked = parsed.join(known.select(*key, F.lit(True).alias("_known")).distinct(), key, "left")
    again = F.row_number().over(Window.partitionBy(*key).orderBy("source", "idx")) > 1
    marked = marked.withColumn("duplicate", F.coalesce("_known", F.lit(False)) | again).drop("_known")
    per = marked.groupBy("source").agg(F.count("*").alias("events"), F.sum(F.col("duplicate").cast("long")).alias("duplicates"))
    before = F.coalesce(F.sum(F.col("events") - F.col("duplicates")).over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before)  # one row for each source
    place = F.row_number().over(Window.partitionBy("source").orderBy("idx"))
    new = marked.where("NOT duplicate").withColumn("_place", place).join(per.select("source", "_before"), "source").where(F.col("_before") + F.col("_place") <= limit)
    fresh = F.col("events") - F.col("duplicates")
    imported = F.greatest(F.lit(0), F.least(fresh, F.lit(limit) - F.col("_before")))
    skipped = F.when(F.col("_before") >= limit, "budget spent").when(fresh == 0, "nothing new")
    return new.select(*parsed.columns), per.select("source", "events", "duplicates", imported.alias("imported"), skipped.alias("skipped"))


def capture_status(scopes: DataFrame, sessions: DataFrame, events: DataFrame) -> DataFrame:
    """scope, active_sessions, events, recent: for each of ``scopes`` (scope), its active sessions, its events and the ids of the newest RECENT_EVENTS."""
    active = sessions.where("status = 'active'").groupBy("scope").agg(F.count("*").alias("active_sessions"))
    n = events.groupBy("scope").agg(F.count("*").alias("events"))
    newest = top(events, ["scope"], [F.col("captured_at").desc(), F.col("id").desc()], RECENT_EVENTS)
    newest = newest.groupBy("scope").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("recent"))
    return scopes.select("scope").distinct().join(active, "scope", "left").join(n, "scope", "left").join(newest, "scope", "left").na.fill(0, ["active_sessions", "events"]).na.fill("", ["recent"])
