"""op1: quality scores of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.quality_classifier import fit, score
from memspark.llm.samples import fold
from memspark.tables import table

THRESHOLD = 0.7


def train(docs: DataFrame, labels: DataFrame):
    """The classifier of the rows whose fold isn't held out."""
    positives = labels.where((F.col("quality") == 1) & (fold("doc_id", 4) != 2)).select("doc_id")
    return fit(docs.where(fold("doc_id", 4) != 2), positives)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
