"""Embedding work: what is embedded of each record type, the queue of jobs, and the store of vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators.changes import upsert_latest
from memspark.operators.listing import list_records
from memspark.operators.search import hash_embedding, keyword_search, top

#: Record types in the order of a listing over all of them.
SECTIONS = ("entity", "observation", "decision", "context")
BATCH = 500


def embeddable(entities: DataFrame, observations: DataFrame, decisions: DataFrame, context: DataFrame) -> DataFrame:
    """record_type, record_id, scope, content of what is embedded.

    Entities by name and type, live observations by content (in their entity's scope), decisions by title and reasoning,
    context by title and content.
    """
    row = lambda df, kind, id_, content: df.select(F.lit(kind).alias("record_type"), F.col(id_).cast("string").alias("record_id"), "scope", content.alias("content"))
    live = observations.where("valid_to IS NULL").join(entities.select(F.col("id").alias("entity_id"), "scope"), "entity_id")
    out = row(entities, "entity", "id", F.concat_ws(" ", "name", "entity_type")).unionByName(row(live, "observation", "id", F.col("content")))
    out = out.unionByName(row(decisions, "decision", "id", F.concat("title", F.lit(" "), F.coalesce("reasoning", F.lit("")))))
    return out.unionByName(row(context, "context", "key", F.concat("title", F.lit(" "), "content")))


def sections(found: dict[str, DataFrame], k: int) -> DataFrame:
    """qid, record_type, id, rank: ranked results (qid, id, rank) of each record type, one type after another in the order of SECTIONS, cut to ``k``."""
    rows = None
    for i, kind in enumerate(SECTIONS):
        if kind in found:
            part = found[kind].select("qid", F.lit(kind).alias("record_type"), F.col("id").cast("string").alias("id"), F.lit(i).alias("_section"), F.col("rank").alias("_rank"))
            rows = part if rows is None else rows.unionByName(part)
    return top(rows, ["qid"], [F.col("_section"), F.col("_rank"), F.col("id")], k).select("qid", "record_type", "id", "rank")


def record_search(queries: DataFrame, records: dict[str, DataFrame], k: int = 10, allowed: DataFrame | None = None, stem: bool = False) -> DataFrame:
    """qid, record_type, id, rank: keyword search over ``records`` (id, content, scope) of each type, one type after another, cut to ``k``.

    Each type has statistics of its own; ``allowed`` (qid, scope) are the scopes that a query sees.
    """
    return sections({kind: keyword_search(queries, rows, k, stem=stem, allowed=allowed) for kind, rows in records.items()}, k)


def pending_jobs(scopes: DataFrame, jobs: DataFrame, k: int = BATCH) -> DataFrame:
    """query_scope, rank, id, record_type, record_id, content_hash: the ``k`` oldest pending ``jobs`` seen from each of ``scopes`` (query_scope)."""
    found = list_records(scopes, jobs, [F.col("created_at"), F.col("id")], k, F.col("status") == "pending")
    return found.select("query_scope", "rank", "id", "record_type", "record_id", "content_hash")


def requeue_failed(jobs: DataFrame, scopes: DataFrame | None = None) -> DataFrame:
    """``jobs`` (id, status, error, scope, ...) whose failed ones, in ``scopes`` (scope) if given, are pending again and without an error."""
    again = F.col("status") == "failed"
    if scopes is not None:
        jobs = jobs.join(scopes.select("scope", F.lit(True).alias("_asked")).distinct(), "scope", "left")
        again &= F.coalesce("_asked", F.lit(False))
    out = jobs.withColumn("_again", again).withColumn("error", F.when(~F.col("_again"), F.col("error"))).withColumn("status", F.when(F.col("_again"), "pending").otherwise(F.col("status")))
    return out.drop("_again", "_asked")


def settle(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``jobs`` after a round of work: status, error and attempts follow ``outcomes`` (id, outcome, error)."""
    done = outcomes.select("id", F.col("outcome").alias("_outcome"), F.col("error").alias("_error"))
    out = jobs.join(done, "id", "left").withColumn("attempts", F.col("attempts") + F.col("_outcome").isNotNull().cast("long"))
    return out.withColumn("error", F.when(F.col("_outcome").isNull(), F.col("error")).otherwise(F.col("_error"))).withColumn("status", F.coalesce("_outcome", "status")).drop("_outcome", "_error")


def drop_closed(vectors: DataFrame, facts: DataFrame) -> DataFrame:
    """``vectors`` without those of observations that ``facts`` (id, valid_to) doesn't hold as live: superseded facts aren't found any more."""
    live = facts.where("valid_to IS NULL").select(F.lit("observation").alias("record_type"), F.col("id").cast("string").alias("record_id"))
    kept = vectors.where("record_type = 'observation'").join(live, ["record_type", "record_id"], "left_semi")
    return vectors.where("record_type <> 'observation'").unionByName(kept.select(*vectors.columns))


def work(jobs: DataFrame, records: DataFrame) -> DataFrame:
    """``jobs`` (id, record_type, record_id, content_hash) with outcome and the scope and content of their records.

    A job whose record is gone, or has changed since (by the SHA-256 of its trimmed content), is skipped with the error.
    """
    both = jobs.join(records.select("record_type", "record_id", F.col("scope").alias("_scope"), "content"), ["record_type", "record_id"], "left")
    error = F.when(F.col("content").isNull(), "record no longer exists").when(F.sha2(F.trim("content"), 256) != F.col("content_hash"), "record content changed")
    return both.withColumn("error", error).withColumn("outcome", F.when(error.isNull(), "embedded").otherwise("skipped"))


def embed(jobs: DataFrame, records: DataFrame, provider: str = "local", model: str = "hash", dim: int = 64, how: Callable[[DataFrame, int], DataFrame] = hash_embedding) -> tuple[DataFrame, DataFrame]:
    """(vectors, outcomes: id, outcome, error) of ``jobs``. ``how`` turns (id, content) into (id, v)."""
    done = work(jobs, records)
    ready = done.where("error IS NULL")
    made = how(ready.select("id", "content"), dim)
    vectors = ready.join(made, "id").select(
        "record_type", "record_id", F.col("_scope").alias("scope"), F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.size("v").alias("dimension"), "content_hash", F.col("v").alias("embedding"), F.col("id").alias("job")
    )
    return vectors, done.select("id", "outcome", "error")


def store_vectors(base: DataFrame, vectors: DataFrame) -> DataFrame:
    """``base`` with ``vectors`` (and their job) in place of those of the same record, provider and model; of several the last job's counts."""
    return upsert_latest(base, vectors, ["record_type", "record_id", "provider", "model"], [F.col("job").desc()])
