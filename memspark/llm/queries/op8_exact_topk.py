"""op8: the 20 highest inner products of every query vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm.topk import top_k
from memspark.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), every=20, k=20, scale=64)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_dot_product(q.v::DOUBLE[], p.v::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v p ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""
