"""Keyword, vector and hybrid retrieval for whole tables of queries."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import scoring
from memspark.operators.postings import Index, index_tokens, search_index
from memspark.operators.vectors import nearest

__all__ = ["ARM_BONUS", "ARM_WEIGHTS", "RANK_CONSTANT", "fuse", "hash_embedding", "index_tokens", "keyword_search", "temporal_boost", "top", "vector_search"]
# Weights of the arms, the rank constant and the bonus for each further arm.
ARM_WEIGHTS = {"keyword": 1.10, "semantic": 1.00, "graph": 0.90}
RANK_CONSTANT, ARM_BONUS = 45, 0.018
#: Tokens of hashed vectors, and the cells of them that a task remembers between batches, at most.
TOKEN, KNOWN_CELLS = re.compile(rb"[a-z0-9]+"), 500_000


def top(found: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return found.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def keyword_search(queries: DataFrame, records: DataFrame, k: int = 10, wanted: Column | None = None, stem: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank: BM25 of ``records`` (id, content, ...) for ``queries`` (qid, query), without a stored index: see ``postings.search_index``."""
    return search_index(queries, Index(records=records), k, wanted, stem, allowed)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10, l2: bool = False) -> DataFrame:
    """qid, id, score, rank: the nearest ``vectors`` (id, v) of ``queries`` (qid, q): cosine above 0, or 1 / (1 + distance).

    Every query meets every vector, in blocks: see ``vectors.nearest``.
    """
    return nearest(queries, vectors, k, l2)


def fuse(arms: DataFrame, k: int = 10) -> DataFrame:
    """qid, id, score, best_rank, rank: reciprocal ranks of ``arms`` (qid, arm, id, rank from 1, boost) weighed and added.

    The boost counts once for each arm; each arm after the first adds a bonus.
    """
    weight = F.create_map(*[F.lit(x) for kv in ARM_WEIGHTS.items() for x in kv])[F.col("arm")]
    part = weight / (RANK_CONSTANT + F.col("rank")) + F.col("boost")
    fused = arms.groupBy("qid", "id").agg(F.sum(part).alias("_s"), F.countDistinct("arm").alias("_arms"), (F.min("rank") - 1).alias("best_rank"))
    fused = fused.select("qid", "id", F.round(F.col("_s") + ARM_BONUS * (F.col("_arms") - 1), 6).alias("score"), "best_rank")
    return top(fused, ["qid"], [F.col("score").desc(), F.col("best_rank"), F.col("id")], k)


class _Cells(dict):
    """By token: twice its place, and one more if its sign is negative; found when first met."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        h = hashlib.sha256(token).digest()
        self[token] = cell = 2 * (int.from_bytes(h[:8], "big") % self.dim) + h[8] % 2
        return cell


def hash_embedding(records: DataFrame, dim: int = 64) -> DataFrame:
    """id, v: hashed-token vectors of ``records`` (id, content), of length 1.

    A token's SHA-256 gives its place (the first eight bytes modulo ``dim``) and its sign (the ninth byte's parity).
    Records of one id count as one text.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(dim)
        for batch in batches:
            ids = batch.column("id").dictionary_encode(null_encoding="encode")
            rows = np.zeros((len(ids.dictionary), dim))
            for at, content in zip(ids.indices.to_numpy(), batch.column("_x"), strict=True):
                n = np.bincount(np.array([cells[t] for t in TOKEN.findall(content.as_py())], np.int64), minlength=2 * dim)
                rows[at] += n[::2] - n[1::2]
            if len(cells) > KNOWN_CELLS:
                cells.clear()
            v = pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, dim), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([ids.dictionary, v], names=["id", "_x"])

    # a record's tokens are added up where they are; ``dim`` numbers of it are shuffled, and of records of one id in a batch
    texts = records.select("id", F.lower(F.coalesce("content", F.lit(""))).cast("binary").alias("_x"))
    parts = texts.mapInArrow(added, f"id {records.schema['id'].dataType.simpleString()}, _x array<double>").groupBy("id").agg(F.collect_list("_x").alias("_p"))
    more = F.aggregate(F.slice("_p", 2, F.size("_p")), F.col("_p")[0], lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
    whole = F.when(F.size("_p") == 1, F.col("_p")[0]).otherwise(more)
    return parts.select("id", scoring.normalised(whole).alias("v"))


def temporal_boost(records: DataFrame, uses: DataFrame, as_of, weight: float = 1.0) -> DataFrame:
    """id, boost for ``records`` (id, category, since) and ``uses`` (id, at): freshness and reuse, as of a given time."""
    hours = lambda c: (F.lit(as_of).cast("timestamp").cast("long") - F.col(c).cast("timestamp").cast("long")) / 3600.0
    used = uses.groupBy("id").agg(F.count("*").alias("_uses"), F.max("at").alias("_last"))
    both = records.join(used, "id", "left")
    salience = scoring.reuse_salience(F.coalesce("_uses", F.lit(0)), F.coalesce(hours("_last"), F.lit(0.0)))
    term = scoring.temporal_term(scoring.category_freshness(F.col("category"), hours("since")), salience)
    return both.select("id", F.round(F.lit(weight) / (RANK_CONSTANT + 1) * term, 8).alias("boost"))
