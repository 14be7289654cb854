"""What reflection is worth: the same search before and after the themes of a graph are approved, promoted and indexed."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators import communities, curation, evaluate, promote, search
from memspark.operators.stored import stored


class Lift(NamedTuple):
    """``metrics``: metric, before, after, lift; ``rerun``: themes, new (proposed again after approval), differing (not byte-equal in a second run)."""

    metrics: DataFrame
    rerun: DataFrame


def reflection_lift(nodes: DataFrame, edges: DataFrame, observations: DataFrame, queries: DataFrame, records: DataFrame, qrels: DataFrame, k: int = 10, **limits: int) -> Lift:
    """The lift of keyword search over ``records`` (id, content) by the themes of a graph.

    The themes that ``communities.reflect`` proposes are approved by review commands, promoted as context records and added to the records;
    a theme is judged like the best of its community's observations in ``qrels`` (qid, id, grade). A second reflection, which knows what was approved, must
    propose nothing and word every theme as the first did. Ids are texts.
    """
    members = stored(communities.louvain(nodes, edges), "members")
    first = stored(communities.reflect(nodes, edges, observations, members=members, **limits), "themes")
    payload = F.to_json(F.struct(F.concat(F.lit("theme-"), "dedup_key").alias("key"), F.col("label").alias("title"), "content"))
    candidates = first.where("status = 'proposed'").select(F.col("dedup_key").alias("id"), F.lit("context").alias("record_type"), F.lit("").alias("scope"), payload.alias("payload"), F.lit("pending").alias("status"))
    approved, _ = curation.review(candidates, candidates.select("id", F.lit(1).alias("place"), F.lit("approve").alias("action")))
    approved = candidates.drop("status").join(approved.where("status = 'approved'").select("id"), "id", "left_semi")
    evidence = first.select(F.col("dedup_key").alias("candidate_id"), "community")
    done = promote.promote(approved, evidence)
    themes = stored(done.tables["context"].select("id", "content"), "theme_records")
    owned = observations.select(F.col("id").cast("string").alias("_obs"), "entity_id").join(members.select(F.col("id").alias("entity_id"), "community"), "entity_id")
    links = done.evidence.where("trusted_record_id IS NOT NULL").select("community", F.col("trusted_record_id").alias("id"))
    of_themes = qrels.join(owned, F.col("id") == F.col("_obs")).groupBy("qid", "community").agg(F.max("grade").alias("grade")).join(links, "community").select("qid", "id", "grade")
    before, after = search.keyword_search(queries, records, k), search.keyword_search(queries, records.unionByName(themes), k)
    judged = qrels.select("qid", "id", "grade").unionByName(of_themes)
    again = communities.reflect(nodes, edges, observations, approved.select(F.col("id").alias("dedup_key")), **limits)
    both = first.select("community", F.col("content").alias("_was")).join(again.select("community", "content", "status"), "community", "full")
    rerun = both.agg(F.count("*").alias("themes"), F.sum(F.coalesce(F.col("status") == "proposed", F.lit(False)).cast("long")).alias("new"), F.sum((~F.col("_was").eqNullSafe(F.col("content"))).cast("long")).alias("differing"))
    return Lift(evaluate.lift(before, after, judged), rerun)
