"""Exact top-k inner products by norm buckets.

Vectors are grouped by length into buckets; within a bucket, shards of bounded size hold the rows. A first round searches
the bucket of the longest vectors and gives each query a lower bound t of its k-th score. In a shard whose longest vector
has length l, a vector p can reach t with query q only if cos(q, p) >= t / (|q| l): the local threshold c. If c is above
1 the shard is skipped. If c is high, coordinates decide: on a coordinate where the query's share is x, the vector's
share must lie within x c -/+ sqrt((1 - x^2)(1 - c^2)). If c is low, length decides: only vectors with |q| |p| >= t are
multiplied. Products of what is left are taken in full, so the result is exact.

Queries meet shards in blocks: a chunk of queries and a shard are one group, so memory is bounded. Queries are chunked by
the length that a vector needs to reach their bound, in levels; a level that needs more than a bucket's longest vector never
meets that bucket, so neither its queries nor the bucket's vectors are sent to such blocks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.store import stored

#: Norm buckets, levels of queries by the length they need.
BUCKETS, LEVELS = 16, 8
#: Components of a shard, and of a chunk of queries, at most on average: 16 MB each. A vector is sent to each chunk that it may meet, and a query to
#: each shard, so the larger both are the fewer copies there are.
SHARD_CELLS, CHUNK_CELLS = 1 << 21, 1 << 21
#: Local thresholds from which coordinates prune; below, lengths do.
BY_COORDINATE = 0.9
#: Coordinates that are looked at: those where the query is largest.
FOCUS = 3


def quantised(vectors: DataFrame, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, v (array of long): floor(scale * x) of every component; vectors that are null or hold null, NaN or infinite components are left out.

    What doesn't fit 64 bits becomes the nearest number that does.
    """
    near = lambda x: F.when(x >= 2.0**63, F.lit(2**63 - 1)).when(x <= -(2.0**63), F.lit(-(2**63))).otherwise(F.floor(x))
    x = F.transform(F.col(vector), lambda c: near(F.lit(float(scale)) * c.cast("double")))
    bad = F.exists(F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return vectors.where(good).select(F.col(key).cast("long").alias("id"), x.alias("v"))


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; those beyond 64 bits become the nearest number of 64 bits."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(query).max(initial=0)) * len(query)
    if most < 2**53:
        return np.rint(vectors.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if most < 2**62:
        return (vectors * query).sum(axis=1)
    exact = vectors.astype(object) @ query.astype(object)
    return np.array([min(max(x, 1 - 2**63), 2**63 - 1) for x in exact], np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def search_shard(query_ids, queries, bounds, ids, vectors, k: int):
    """(query id, vector id, score) of what can be among a query's k best, for one chunk of queries and one shard: arrays of 64-bit integers.

    ``bounds``: a score that a query's k-th best surely reaches, or NaN.
    """
    plain, as_double = queries.astype(np.float64), vectors.astype(np.float64)
    norm, length = np.sqrt((plain**2).sum(axis=1)), np.sqrt((as_double**2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    ids, vectors, length = ids[order], vectors[order], length[order]
    share = as_double[order] / np.maximum(length, 1e-300)[:, None]
    out = []
    for q in range(len(query_ids)):
        t = bounds[q]
        if np.isnan(t) or t <= 0 or norm[q] == 0:
            rows = np.arange(len(ids))
        else:
            c = t / (norm[q] * length[0]) if length[0] else 2.0
            if c > 1 + 1e-9:
                continue
            # lengths descend: everything after the first short vector is short
            rows = np.arange(np.searchsorted(-length, -(t / norm[q]) * (1 - 1e-9), "right"))
            if c >= BY_COORDINATE:
                mine = plain[q] / norm[q]
                for f in np.argsort(-np.abs(mine), kind="stable")[:FOCUS]:
                    local = np.minimum(t / (norm[q] * length[rows]), 1.0)
                    room = np.sqrt(np.maximum(0.0, (1 - mine[f] ** 2) * (1 - local**2))) + 1e-9
                    rows = rows[np.abs(share[rows, f] - mine[f] * local) <= room + np.abs(mine[f]) * (1 - local)]
        rows = rows[ids[rows] != query_ids[q]]
        if not len(rows):
            continue
        scores = _products(vectors[rows], queries[q])
        if not np.isnan(t):
            high = scores >= t - abs(t) * 1e-15  # the bound is a rounded number
            rows, scores = rows[high], scores[high]
        best = _best(scores, ids[rows], k)
        out.append((np.full(len(best), query_ids[q]), ids[rows][best], scores[best]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _spread(index: Column, blocks: dict[int, list[tuple[int, int]]]) -> Column:
    """structs (of, part): for row class ``index``, parts 0 .. n - 1 of every (of, n) that ``blocks`` has for it."""
    none = F.expr("CAST(array() AS ARRAY<STRUCT<of: INT, n: INT>>)")
    lists = [F.array(*[F.struct(F.lit(of).alias("of"), F.lit(n).alias("n")) for of, n in pairs]) if pairs else none for _, pairs in sorted(blocks.items())]
    table = F.element_at(F.array(*lists), (index + 1).cast("int"))
    return F.flatten(F.transform(table, lambda b: F.transform(F.sequence(F.lit(0), b["n"] - 1), lambda i: F.struct(b["of"].alias("of"), i.alias("part")))))


def _round(queries: DataFrame, vectors: DataFrame, k: int, shards: dict[int, int], chunks: dict[int, int], meets: Callable[[int, int], bool]) -> DataFrame:
    """query_id, vec_id, score: candidates of ``queries`` (_level, _chunk, id, v, _bound) within ``vectors`` (_bucket, _shard, id, v).

    ``shards`` and ``chunks`` count those of each bucket and level; ``meets``(level, bucket) says which of them meet at all.
    """
    levels, buckets = range(LEVELS), range(BUCKETS)
    to = {level: [(b, shards[b]) for b in buckets if shards.get(b) and meets(level, b)] for level in levels}
    back = {b: [(level, chunks[level]) for level in levels if chunks.get(level) and meets(level, b)] for b in buckets}
    left = queries.withColumn("_p", F.explode(_spread(F.col("_level"), to)))
    left = left.select("_level", "_chunk", F.col("_p.of").alias("_bucket"), F.col("_p.part").alias("_shard"), F.lit(True).alias("_query"), "id", "v", "_bound")
    right = vectors.withColumn("_p", F.explode(_spread(F.col("_bucket"), back)))
    right = right.select(F.col("_p.of").alias("_level"), F.col("_p.part").alias("_chunk"), "_bucket", "_shard", F.lit(False).alias("_query"), "id", "v", F.lit(None).cast("double").alias("_bound"))

    def run(table):
        mine = table.column("_query").to_numpy()
        id_, bound = table.column("id").to_numpy(), table.column("_bound").to_pandas().to_numpy(float)
        lists = table.column("v").combine_chunks()
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        size = np.diff(offsets)
        rows = lambda at, n: values[offsets[at][:, None] + np.arange(n)]
        found = []
        for n in np.unique(size[mine]) if mine.any() else ():
            q, p = np.flatnonzero(mine & (size == n)), np.flatnonzero(~mine & (size == n))
            if len(p) and n:
                found.append(search_shard(id_[q], rows(q, n), bound[q], id_[p], rows(p, n), k))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    both = left.unionByName(right).groupBy("_level", "_chunk", "_bucket", "_shard")
    return both.applyInArrow(run, "query_id long, vec_id long, score long")


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest integer inner products of each query, ties to smaller ids.

    Queries are the rows whose id is divisible by ``every``; candidates all rows but those of the query's own id.
    Vectors that are null or hold null or non-finite components take no part, nor do rows without id; vectors of
    different dimension don't meet. A score beyond 64 bits counts as the nearest number of 64 bits. Rows of one id are candidates each; a repeated query is asked once per distinct
    vector, and equal answers to it count once. An empty table gives none.
    """
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # a random number of each row, written with it, deals rows to shards: a repeated id is no hot shard
    rows = stored(quantised(vectors, scale, key, vector).withColumns({"_length": length, "_u": F.rand(7)}), "vectors")
    edges = rows.approxQuantile("_length", [i / BUCKETS for i in range(1, BUCKETS)], 0.005)  # a few numbers
    rows = rows.withColumn("_bucket", sum((F.when(F.col("_length") >= e, 1).otherwise(0) for e in edges), F.lit(0)))
    per = rows.groupBy("_bucket").agg(F.count("*").alias("n"), F.max("_length").alias("longest"), F.max(F.size("v")).alias("width")).collect()  # BUCKETS rows at most
    if not per:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score")).where("false")
    shards = {r["_bucket"]: max(1, -(-r["n"] * max(1, r["width"]) // SHARD_CELLS)) for r in per}
    longest = {r["_bucket"]: r["longest"] for r in per}
    n_shards = F.element_at(F.array(*[F.lit(shards.get(b, 1)) for b in range(BUCKETS)]), (F.col("_bucket") + 1).cast("int"))
    rows = rows.withColumn("_shard", F.floor(F.col("_u") * n_shards).cast("int"))
    asked = rows.where(F.col("id") % every == 0).groupBy("id", "v").agg(F.min("_length").alias("_length"))
    dealt = lambda n: F.pmod(F.xxhash64("id", "v"), n).cast("int").alias("_chunk")
    width = max(1, *(r["width"] for r in per))
    chunks = max(1, -(-asked.count() * width // CHUNK_CELLS))
    top = max(shards)
    asked = stored(asked, "asked")
    first = asked.select(F.lit(0).alias("_level"), dealt(F.lit(chunks)), "id", "v", F.lit(None).cast("double").alias("_bound"))
    first = _round(first, rows.where(F.col("_bucket") == top), k, {top: shards[top]}, {0: chunks}, lambda level, b: level == 0)
    first = stored(_top(first, k), "first")
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("_bound"))
    # the length that a vector needs; the slack is for rounding
    need = F.when((F.col("_bound") > 0) & (F.col("_length") > 0), F.col("_bound") / F.col("_length") * (1 - 1e-9)).otherwise(0.0)
    asked = stored(asked.join(bounds, "id", "left").withColumn("_need", need), "bounded")
    steps = sorted(set(asked.approxQuantile("_need", [i / LEVELS for i in range(1, LEVELS)], 0.005)))
    asked = asked.withColumn("_level", sum((F.when(F.col("_need") >= e, 1).otherwise(0) for e in steps), F.lit(0)))
    levels = asked.groupBy("_level").agg(F.count("*").alias("n"), F.min("_need").alias("least")).collect()  # LEVELS rows at most
    chunks = {r["_level"]: max(1, -(-r["n"] * width // CHUNK_CELLS)) for r in levels}
    least = {r["_level"]: r["least"] for r in levels}
    n_chunks = F.element_at(F.array(*[F.lit(chunks.get(i, 1)) for i in range(LEVELS)]), (F.col("_level") + 1).cast("int"))
    meets = lambda level, b: b != top and longest[b] >= least[level]
    rest = _round(asked.select("_level", dealt(n_chunks), "id", "v", "_bound"), rows.where(F.col("_bucket") != top), k, shards, chunks, lambda i, b: i in least and b in longest and meets(i, b))
    found = first.select("query_id", "vec_id", "score").unionByName(rest)
    return _top(found, k).select("query_id", "rank", "vec_id", "score")
