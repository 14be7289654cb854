"""Bounded training samples of documents, and folds by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % n


def sample(ids: DataFrame, most: int, key: str, seed: int) -> DataFrame:
    """At most ``most`` rows of ``ids``, those with the smallest hash of the id: the same ones in every run."""
    n = ids.count()
    draw = F.xxhash64(key, F.lit(seed))
    if n > most:  # a first cut that keeps a few more than needed, so that the sort stays small
        ids = ids.where(draw < int(-(2**63) + 2**64 * min(0.999, 1.2 * most / n)))
    return ids.orderBy(draw, key).limit(most)
