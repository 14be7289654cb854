"""op6: token counts of every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memspark.llm.token_counts import token_counts
from memspark.tables import table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), LIMIT)
