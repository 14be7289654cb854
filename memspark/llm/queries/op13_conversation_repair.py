"""op13: the cheapest repair of every damaged conversation. SQL has no search by cost; a test compares with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm.conversations import damaged, repair
from memspark.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
