"""op4: the main text of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm.html_text import extract
from memspark.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
