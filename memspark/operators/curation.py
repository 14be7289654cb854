"""Candidate facts: calibrated lists, bulk review, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import scoring


def calibrated_candidates(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """``candidates`` (id, source_type, ...) with evidence_count, calibrated confidence, uncertainty and review priority."""
    n = evidence.groupBy(F.col("candidate_id").alias("id")).agg(F.count("*").alias("evidence_count"))
    out = candidates.join(n, "id", "left").withColumn("evidence_count", F.coalesce("evidence_count", F.lit(0)))
    c = scoring.calibrated(scoring.source_prior(F.col("source_type")), 1 + F.col("evidence_count"))
    out = out.withColumn("calibrated", F.round(c, 6))
    return out.withColumn("uncertainty", F.round(scoring.uncertainty(c), 6)).withColumn("review_priority", F.round(scoring.review_priority(c, F.col("evidence_count")), 6))


def review(candidates: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(succeeded: id, status; failed: id, place, error) of review ``commands`` (id, place, action: approve or reject).

    The first command of an id counts; a later one, one on a candidate that isn't pending, or on none, fails.
    """
    w = Window.partitionBy("id").orderBy("place")
    both = commands.withColumn("_n", F.row_number().over(w)).withColumn("_first", F.first("action").over(w)).join(candidates.select("id", "status"), "id", "left")
    done = lambda a: F.when(a == "approve", "approved").otherwise("rejected")
    error = F.when(F.col("status").isNull(), "not found").when(F.col("status") != "pending", F.concat(F.lit("already "), "status")).when(F.col("_n") > 1, F.concat(F.lit("already "), done(F.col("_first"))))
    both = both.withColumn("error", error)
    return both.where("error IS NULL").select("id", done(F.col("action")).alias("status")), both.where("error IS NOT NULL").select("id", "place", "error")


def promoted(candidates: DataFrame, fields: dict[str, tuple[list[str], str | None]], payload: str = "payload") -> DataFrame:
    """id and the ``fields`` of JSON payloads: the first of a field's aliases that is there, else its default."""
    pick = lambda names, other: F.coalesce(*[F.get_json_object(payload, f"$.{n}") for n in names], F.lit(other))
    return candidates.select("id", *[pick(*how).alias(name) for name, how in fields.items()])


def noisy(confidence: Column, evidence: Column, content: Column) -> Column:
    """Candidates that are hardly worth a review: weak, weak without evidence, or nearly empty."""
    return (confidence < 0.45) | ((evidence == 0) & (confidence < 0.65)) | (F.length(content) < 16)


def review_groups(candidates: DataFrame) -> DataFrame:
    """day, label, items, pending, noisy of ``candidates`` (created_at, label, status, confidence, evidence_count, content)."""
    flag = noisy(F.col("confidence"), F.col("evidence_count"), F.col("content"))
    return candidates.groupBy(F.to_date("created_at").alias("day"), "label").agg(
        F.count("*").alias("items"), F.sum((F.col("status") == "pending").cast("long")).alias("pending"), F.sum(flag.cast("long")).alias("noisy")
    )
