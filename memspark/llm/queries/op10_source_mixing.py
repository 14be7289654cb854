"""op10: the mix of all documents by source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm.mixing import mix_sources
from memspark.tables import table


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")
