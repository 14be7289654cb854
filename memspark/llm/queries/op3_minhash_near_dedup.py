"""op3: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm.minhash import near_duplicates
from memspark.tables import table

PERCENT = 85


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), PERCENT)
