"""op2: toxicity scores of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.samples import fold
from memspark.llm.toxicity import fit, score
from memspark.tables import table

THRESHOLD = 0.5


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("_toxic")))
    scored = score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
