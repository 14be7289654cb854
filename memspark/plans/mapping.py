"""Memory tables derived from the given tables, for the registered queries; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators.stored import spread
from memspark.tables import table


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as facts of the entity that their source names."""
    kinds = {"en": "general", "fr": "decision", "de": "risk", "es": "progress"}
    category = F.coalesce(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("lang")], F.lit("learned"))
    source_type = F.element_at(F.array(*map(F.lit, ("manual", "agent:transcript", "agent", "inferred"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("entity_id"), F.col("text").alias("content"), category.alias("category"), source_type.alias("source_type"),
        (0.5 + (F.col("doc_id") % 50) / 100).alias("confidence"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("valid_from"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("2030-01-01 00:00:00").cast("timestamp")).alias("valid_to"),
    )


OBSERVATIONS_SQL = """observations AS (
  SELECT doc_id AS id, source AS entity_id, text AS content,
    CASE lang WHEN 'en' THEN 'general' WHEN 'fr' THEN 'decision' WHEN 'de' THEN 'risk' WHEN 'es' THEN 'progress' ELSE 'learned' END AS category,
    ['manual', 'agent:transcript', 'agent', 'inferred'][doc_id % 4 + 1] AS source_type, 0.5 + (doc_id % 50) / 100 AS confidence,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS valid_from, CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '2030-01-01 00:00:00' END AS valid_to
  FROM documents)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and parts as entities; a supplier's scope is its nation, a part's its own path under ``parts``."""
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("nation/"), F.col("s_nationkey").cast("string")).alias("scope"), F.lit("supplier").alias("entity_type"))
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("parts").alias("scope"), F.lit("part").alias("entity_type"))
    return supplier.unionByName(part)


ENTITIES_SQL = """entities AS (
  SELECT 's' || s_suppkey AS id, 'nation/' || s_nationkey AS scope, 'supplier' AS entity_type FROM supplier
  UNION ALL SELECT 'p' || p_partkey, 'parts', 'part' FROM part)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part, weighted by the lines that have both."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey")
    # nearly all pairs differ, so sums before the shuffle would only fill memory
    pairs = spread(lines, lines.count(), "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    return pairs.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "weight")


RELATIONS_SQL = """relations AS (
  SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY l_suppkey, l_partkey)"""
