"""op5: every document packed into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from memspark.llm.packing import pack
from memspark.tables import table

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), CAPACITY)
