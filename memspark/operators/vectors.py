"""Vector search by blocks: exact over all vectors, and over an index of cells.

A block is some queries and some vectors as arrays in a task; one matrix product gives its scores, and only the best of each
query leave it. The index deals vectors into cells by their nearest centroid; a query reads the cells nearest to it. Centroids
and the number of cells that a query reads are fitted on a bounded sample, the latter so that the sample's recall reaches
a target; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators.stored import stored

#: Queries that are sent to each task, at most; beyond, queries of a chunk and vectors of a shard.
BROADCAST_QUERIES, BLOCK_QUERIES, BLOCK_VECTORS = 2_000, 2_000, 20_000
#: Vectors of the sample that an index is fitted on, its queries, and the recall that it must reach there.
SAMPLE, SAMPLE_QUERIES, RECALL = 20_000, 200, 0.97
#: Results that an index search keeps before it filters: so many times as many as are wanted, and at most. Fixed values.
OVER_FETCH, MOST_FETCHED = 8, 500


def _matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: the rows of ``column`` that hold a vector of finite numbers, and these."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.list_(pa.float64()))
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(column).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    out = {}
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        found = values[starts[rows][:, None] + np.arange(n)]
        whole = np.isfinite(found).all(axis=1)
        if whole.any():
            out[int(n)] = rows[whole], found[whole]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def _distances(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(v)))
    for row, x in zip(out, q, strict=True):
        row[:] = ((v - x) ** 2).sum(axis=1)
    return np.sqrt(out, out=out)


def _best(queries: dict, vectors: dict, ids: pa.Array, k: int, l2: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of queries, rows of vectors, scores) of the best ``k`` of each query; of equal scores, to six decimals, those with the smallest ids."""
    order = np.empty(len(ids), np.int64)
    order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    for n, (rows, v) in vectors.items():
        if n not in queries:
            continue
        by_id = np.argsort(order[rows])
        rows, v = rows[by_id], v[by_id]
        asked, q = queries[n]
        v = v if l2 else _unit(v)
        step = 32 if l2 else 256
        for lo in range(0, len(q), step):
            some = q[lo : lo + step]
            scores = 1 / (1 + _distances(some, v)) if l2 else _unit(some) @ v.T
            for i, s in enumerate(scores):
                rounded = np.round(s, 6)
                near = np.arange(len(s)) if len(s) <= k else np.flatnonzero(rounded >= np.partition(rounded, len(s) - k)[len(s) - k])
                near = near[np.argsort(-rounded[near], kind="stable")[:k]]
                if not l2:
                    near = near[rounded[near] > 0]
                yield np.full(len(near), asked[lo + i]), rows[near], s[near]


def _pairs(qids: pa.Array, queries: dict, ids: pa.Array, column: pa.Array, k: int, l2: bool, names: list[str]) -> pa.Table:
    found = list(_best(queries, _matrices(column), ids, k, l2))
    a, b, s = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64 if i < 2 else float) for i in range(3))
    return pa.Table.from_arrays([qids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64())), pa.array(s, pa.float64())], names=names)


def _schema(queries: DataFrame, vectors: DataFrame) -> str:
    return f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def blocks(queries: DataFrame, vectors: DataFrame, keys: list[str], k: int, l2: bool) -> DataFrame:
    """qid, id, score: the best ``k`` of each block of ``queries`` (keys, qid, q) and ``vectors`` (keys, id, v) of equal ``keys``."""

    def run(q: pa.Table, v: pa.Table) -> pa.Table:
        return _pairs(_one(q["qid"]), _matrices(q["q"]), _one(v["id"]), _one(v["v"]), k, l2, ["qid", "id", "score"])

    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(run, _schema(queries, vectors))


def _first(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "id")
    return found.select("qid", "id", F.round("score", 6).alias("score")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 10, l2: bool = False) -> DataFrame:
    """qid, id, score, rank: the nearest of all ``vectors`` (id, v) to ``queries`` (qid, q): cosine above 0, or 1 / (1 + distance).

    Up to BROADCAST_QUERIES queries go to the tasks that read the vectors, which aren't shuffled; more meet the vectors in blocks, as an equi-join of
    chunks of queries with shards of vectors, so that no task holds either side whole. Vectors of another length, null ones, and those
    with components that are null or no finite numbers take no part.
    """
    queries, vectors = queries.select("qid", "q"), vectors.select("id", "v")
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        asked = queries.toArrow()
        sent = _one(asked["qid"]) if n else pa.array([], asked.schema.field("qid").type), _matrices(asked["q"]) if n else {}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _pairs(*sent, batch.column(0), batch.column(1), k, l2, ["qid", "id", "score"]).to_batches()

        return _first(vectors.mapInArrow(run, _schema(queries, vectors)), k)
    chunks, shards = -(-n // BLOCK_QUERIES), -(-vectors.count() // BLOCK_VECTORS)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    q = queries.withColumn("_chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int")).withColumn("_shard", every(shards))
    v = vectors.withColumn("_shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("_chunk", every(chunks))
    return _first(blocks(q, v, ["_chunk", "_shard"], k, l2), k)


class VectorIndex(NamedTuple):
    """``rows``: cell, shard, id, v and other columns of every vector; ``sizes``: cell, shards; the cells' centroids; how many of them a query reads."""

    rows: DataFrame
    sizes: DataFrame
    centroids: np.ndarray
    probes: int


def _centroids(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a sample by Lloyd's rounds, from rows far apart in its order."""
    c = x[np.linspace(0, len(x) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        near = _cells(x, c, 1)[:, 0]
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _cells(x: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of each row, nearest first."""
    out = []
    for lo in range(0, len(x), 4096):
        d = (centroids**2).sum(axis=1) - 2 * x[lo : lo + 4096] @ centroids.T
        out.append(np.argsort(d, axis=1, kind="stable")[:, :n])
    return np.concatenate(out) if out else np.zeros((0, n), int)


def _needed(x: np.ndarray, centroids: np.ndarray, k: int) -> int:
    """Cells that a query must read so that RECALL of its ``k`` nearest rows of the sample are found."""
    own, asked = _cells(x, centroids, 1)[:, 0], x[:: max(1, len(x) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    place = np.argsort(_cells(asked, centroids, len(centroids)), axis=1)
    need = np.concatenate([place[i, own[np.argsort(((x - q) ** 2).sum(axis=1), kind="stable")[:k]]] for i, q in enumerate(asked)])
    return int(np.sort(need)[min(len(need) - 1, int(np.ceil(RECALL * len(need))))]) + 1


def build_vector_index(vectors: DataFrame, cells: int | None = None, k: int = 10) -> VectorIndex:
    """The index of ``vectors`` (id, v and other columns), all of one length; others, and those without finite numbers, aren't indexed.

    The sample is the SAMPLE vectors whose ids have the smallest hashes. There are as many ``cells`` as the root of the number of vectors,
    2,048 at most, if not given.
    """
    sample = _matrices(vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"])
    n, (_, x) = max(sample.items(), key=lambda f: len(f[1][0]), default=(0, (None, np.zeros((0, 1)))))
    cells = min(cells or max(1, int(vectors.count() ** 0.5)), 2_048, max(1, len(x)))
    centroids = _centroids(x, cells) if len(x) else np.zeros((1, 1))
    probes = _needed(x, centroids, k) if len(x) else 1
    kept = vectors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, v = _matrices(batch.column(kept.index("v"))).get(n, (np.zeros(0, int), np.zeros((0, max(n, 1)))))
            cell = _cells(v, centroids, 1)[:, 0] if len(rows) else np.zeros(0, int)
            taken = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *taken.columns], names=["cell", *kept])

    schema = "cell int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    found = stored(vectors.mapInArrow(run, schema), "cells")
    sizes = stored(found.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_VECTORS).cast("int").alias("shards")), "cell_sizes")
    # a cell with many vectors, such as copies of one, is several blocks
    sized = found.join(F.broadcast(sizes), "cell").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).drop("shards")  # 2,048 cells at most
    return VectorIndex(stored(sized.repartitionByRange("cell", "shard").sortWithinPartitions("cell", "shard"), "vector_index"), sizes, centroids, probes)


def search_vectors(queries: DataFrame, index: VectorIndex, k: int = 10, probes: int | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank: the nearest vectors by 1 / (1 + distance) to ``queries`` (qid, q) among the cells that each reads.

    OVER_FETCH times ``k`` results, MOST_FETCHED at most, are found first and then cut to the ``allowed`` rows (qid and columns of the index, such
    as record_type and scope). A query without a vector of the index's length finds nothing.
    """
    fetched = min(max(OVER_FETCH * k, k), max(MOST_FETCHED, k))
    n, dim, centroids = min(probes or index.probes, len(index.centroids)), index.centroids.shape[1], index.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, q = _matrices(batch.column(1)).get(dim, (np.zeros(0, int), np.zeros((0, dim))))
            cell = _cells(q, centroids, n)
            taken = batch.take(pa.array(np.repeat(rows, n), pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cell.ravel(), pa.int32())], names=["qid", "q", "cell"])

    asked = queries.select("qid", "q")
    asked = asked.mapInArrow(run, f"qid {asked.schema['qid'].dataType.simpleString()}, q {asked.schema['q'].dataType.simpleString()}, cell int")
    asked = asked.join(F.broadcast(index.sizes), "cell").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    chunks = -(-queries.count() // BLOCK_QUERIES) or 1
    asked = asked.withColumn("chunk", F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int"))
    rows = index.rows.select("cell", "shard", "id", "v", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    found = _first(blocks(asked.select("cell", "shard", "chunk", "qid", "q"), rows, ["cell", "shard", "chunk"], fetched, True), fetched)
    if allowed is None:
        return found.where(F.col("rank") <= k)
    names = [c for c in allowed.columns if c != "qid"]
    found = found.drop("rank").join(index.rows.select("id", *names), "id").join(allowed.distinct(), ["qid", *names], "left_semi")
    return _first(found.select("qid", "id", "score"), k)
