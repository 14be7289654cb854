"""Near-duplicate documents by min-max hashing.

Every document is the set of its distinct word shingles. Under each permutation of the shingles both the smallest and the
largest value are kept: each agrees for two sets with a probability equal to their Jaccard similarity, so half the
permutations give a signature of the usual length. Bands of the signature are bucket keys.

1. One scan makes set size, set fingerprint and signature of each document. Documents with equal sets form a class, and
   only its smallest id goes on.
2. In each bucket every class is paired with the one that has the most bucket mates: a star, never all pairs. Pairs whose
   sizes allow the similarity are confirmed on the full shingle sets, and confirmed links give first components.
3. What a star can miss is a link between two classes that share a bucket but no component yet. Buckets with several
   components are cut into cells of neighbouring sizes, and what is outside a cell's largest component is compared with
   the cell's members, block by block, on full shingle sets. A task returns only links that join components.
4. Components of all links, by joining ids to their smallest neighbours and contracting the links in rounds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.names import inner
from memspark.llm.store import stored
from memspark.llm.textbatch import Words, constants, shingles, slices, small_batches, tidy

SHINGLE = 5
#: Bands of ROWS signature values: a pair at similarity 0.85 shares no band with a probability of 4e-7.
BANDS, ROWS = 20, 4
PERMUTATIONS = BANDS * ROWS // 2
#: Tables of this many narrow rows at most are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 400_000
#: Pairs of a hot document that are confirmed together; members and shingles of a block, on average at most.
TOGETHER, BLOCK, BLOCK_SHINGLES = 64, 128, 1 << 19


def _signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, 2 * PERMUTATIONS) unsigned 32-bit values; sets must not be empty."""
    a, b = constants(PERMUTATIONS, 101), constants(PERMUTATIONS, 202)
    out = np.empty((len(offsets) - 1, 2 * PERMUTATIONS), np.uint32)
    for k in range(PERMUTATIONS):
        x = (((values ^ b[k]) * a[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * k] = np.minimum.reduceat(x, offsets[:-1])
        out[:, 2 * k + 1] = np.maximum.reduceat(x, offsets[:-1])
    return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    """(sets, BANDS) bucket keys. A band takes values of different permutations: first minima, then maxima."""
    by_kind = np.concatenate([signatures[:, 0::2], signatures[:, 1::2]], axis=1).reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = (by_kind * constants(ROWS, 303)).sum(axis=2, dtype=np.uint64)
    key = (key ^ (key >> np.uint64(29))) * constants(BANDS, 404) + constants(BANDS, 505)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def shingle_sets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """id, n_shingles, f1, f2 (fingerprint of the set), signature (binary) of every row; without shingles the signature is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                values, at = shingles(Words(data, offsets), SHINGLE)
                n = np.diff(at)
                has = np.flatnonzero(n)
                f1, f2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                raw: list[bytes | None] = [None] * len(n)
                if len(has):
                    starts = at[:-1][has]
                    f1[has] = np.add.reduceat(values, starts)
                    f2[has] = np.bitwise_xor.reduceat(values * constants(1, 7)[0], starts)
                    for i, s in zip(has.tolist(), _signatures(values, np.append(starts, len(values))), strict=True):
                        raw[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(raw, pa.binary())],
                    names=["id", "n_shingles", "f1", "f2", "signature"],
                )

    rows = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    return rows.mapInArrow(tidy(run), "id long, n_shingles long, f1 long, f2 long, signature binary")


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, id, n: a row for each class and band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                raw = part.column(2).to_pylist()
                keys = _bands(np.frombuffer(b"".join(raw), np.uint32).reshape(len(raw), -1))
                take = pa.array(np.repeat(np.arange(len(raw)), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), part.column(0).take(take), part.column(1).take(take)], names=["bucket", "id", "n"])

    return classes.select("id", "n", "signature").mapInArrow(tidy(run), "bucket long, id long, n long")


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has few rows; ``df`` is a stored table of narrow rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _confirmed(pairs: DataFrame, docs: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets reach the similarity."""
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("_salts"))
    degree = stored(degree, "degrees")
    salted = pairs.join(_small(degree), "a").withColumn("_salt", F.pmod(F.xxhash64("b"), "_salts"))
    salted = stored(salted.select("a", "b", "_salt"), "salted")
    texts = docs.select(docs[key].cast("long").alias("_id"), docs[text].alias("text"))
    left = texts.withColumnsRenamed({"_id": "b", "text": "text_b"}).join(_small(salted), "b")
    right = texts.withColumnsRenamed({"_id": "a", "text": "text_a"}).join(_small(degree), "a")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    both = left.hint("merge").join(right, ["a", "_salt"]).select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text_b"):
                values, at = shingles(Words(data, offsets), SHINGLE)
                a = part.column(0).to_numpy()
                turn = np.flatnonzero(np.append(True, a[1:] != a[:-1]))  # rows come sorted by a
                keep = np.zeros(len(a), bool)
                for lo, hi in zip(turn.tolist(), [*turn[1:].tolist(), len(a)], strict=True):
                    for _, d, o in slices(part.slice(lo, 1), "text_a"):
                        own, _ = shingles(Words(d, o), SHINGLE)
                    for i in range(lo, hi):
                        other = values[at[i] : at[i + 1]]
                        if 100 * min(len(own), len(other)) >= percent * max(len(own), len(other)) > 0:
                            common = len(own) + len(other) - len(np.union1d(own, other))
                            keep[i] = 100 * common >= percent * (len(own) + len(other) - common)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in part.columns[:2]], names=["a", "b"])

    with small_batches(docs.sparkSession):
        return stored(both.mapInArrow(tidy(run), "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """id, component for every id in the links (a, b): the smallest id that it reaches.

    Each round joins every id to its smallest neighbour, and that one's, and then draws the links between what is left:
    links within a group vanish, so the rounds shrink fast.
    """
    edges = stored(links.select("a", "b").union(links.select("b", "a")).toDF("src", "dst").distinct(), "edges")
    labels, turn = None, 0
    while True:
        turn += 1
        near = edges.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("to"))
        near = stored(near, f"near{turn}")
        far = near.select(F.col("id").alias("to"), F.col("to").alias("_far"))
        step = stored(near.join(far, "to").select("id", F.least("to", "_far").alias("to")), f"step{turn}")
        if labels is None:
            labels = step.withColumnRenamed("to", "component")
        else:
            labels = labels.join(step.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
            labels = stored(labels, f"labels{turn}")
        drawn = edges.join(step.withColumnRenamed("id", "src"), "src").select(F.col("to").alias("src"), "dst")
        drawn = drawn.join(step.withColumnRenamed("id", "dst"), "dst").select("src", F.col("to").alias("dst")).where("src <> dst").distinct()
        edges = stored(drawn, f"edges{turn}")
        if not edges.limit(1).count():
            return labels


def _links_between(minor: list[np.ndarray], others: list[np.ndarray], percent: int) -> np.ndarray:
    """Pairs of positions (in ``minor``, in ``others``) of shingle sets that reach the similarity."""
    size, many = (np.array([len(x) for x in sets]) for sets in (minor, others))
    member = np.repeat(np.arange(len(minor) + len(others)), np.concatenate([size, many]))
    _, code, count = np.unique(np.concatenate([*minor, *others]), return_inverse=True, return_counts=True)
    shared = count[code] > 1  # shingles of one member add nothing
    rank = np.cumsum(count > 1) - 1
    member, code = member[shared], rank[code[shared]]
    order = np.argsort(code, kind="stable")
    member, code = member[order], code[order]
    common = np.zeros((len(minor), len(others)), np.float32)
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        here = slice(*np.searchsorted(code, (lo, lo + 4096)))
        has = np.zeros((len(minor) + len(others), 4096), np.float32)
        has[member[here], code[here] - lo] = 1
        common += has[: len(minor)] @ has[len(minor) :].T
    return np.argwhere(100 * common >= percent * (size[:, None] + many[None, :] - common))


def _joining(pairs: list[tuple[int, int]]) -> list[int]:
    """Positions of those ``pairs`` of components that join what nothing before has joined."""
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while root.setdefault(c, c) != c:
            root[c] = c = root[root[c]]
        return c

    found = []
    for i, (x, y) in enumerate(pairs):
        a, b = find(x), find(y)
        if a != b:
            root[a] = b
            found.append(i)
    return found


def full_sets(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id, shingles (binary: 64-bit hashes in ascending order) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                values, at = shingles(Words(data, offsets), SHINGLE)
                raw = values.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[8 * x : 8 * y] for x, y in zip(at, at[1:], strict=False)], pa.binary())], names=["id", "shingles"])

    return docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text")).mapInArrow(tidy(run), "id long, shingles binary")


def _second_links(rows: DataFrame, labels: DataFrame, docs: DataFrame, text: str, key: str, percent: int) -> DataFrame:
    """Links between components within the buckets of ``rows`` (bucket, id, n): enough of them to join what belongs together.

    A cell is a bucket's members of two neighbouring classes of size: others can't reach the similarity. Buckets that make
    the same cell count once. Within a cell only what is outside its largest component is compared, with all of the cell.
    """
    known = rows.join(_small(labels), "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    known = stored(known, "labelled")
    mixed = known.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("bucket")
    class_ = F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
    cells = known.join(_small(stored(mixed, "mixed_buckets")), "bucket").withColumn("_class", class_)
    cells = cells.withColumn("_cell", F.explode(F.array(F.col("_class"), F.col("_class") - 1)))
    per = cells.groupBy("bucket", "_cell", "component").agg(
        F.count("*").alias("_n"), F.sum("n").alias("_size"), F.expr("bit_xor(xxhash64(id))").alias("_x"), F.sum(F.xxhash64("id", F.lit(1)) % (1 << 40)).alias("_y"), F.max(F.col("_class") == F.col("_cell")).alias("_own")
    )
    per = stored(per, "cells")
    whole = per.groupBy("bucket", "_cell").agg(
        F.count("*").alias("_components"), F.sum("_n").alias("_all"), F.sum("_size").alias("_sizes"), F.expr("bit_xor(_x)").alias("_x"), F.sum("_y").alias("_y"),
        F.max(F.struct("_n", "_size", -F.col("component"))).alias("_top"), F.max("_own").alias("_own"),
    )
    whole = whole.where("_components > 1 AND _own").groupBy("_cell", "_all", "_x", "_y").agg(F.min(F.struct("bucket", "_sizes", "_top")).alias("_one"))
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    whole = whole.select(
        F.col("_one.bucket").alias("bucket"), "_cell", (-F.col("_one._top.col3")).alias("_major"), blocks(F.col("_all"), F.col("_one._sizes")).alias("_rights"),
        blocks(F.col("_all") - F.col("_one._top._n"), F.col("_one._sizes") - F.col("_one._top._size")).alias("_lefts"),
    )
    members = cells.select("bucket", "_cell", "id", "component").join(_small(stored(whole, "mixed_cells")), ["bucket", "_cell"])
    spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    one = lambda left, i, j: F.transform(spread(j if left else i), lambda k: F.struct(*((block(i).alias("i"), k.alias("j")) if left else (k.alias("i"), block(j).alias("j"))), F.lit(left).alias("left")))
    places = F.concat(F.when(F.col("component") != F.col("_major"), one(True, "_lefts", "_rights")).otherwise(F.slice(one(True, "_lefts", "_rights"), 1, 0)), one(False, "_lefts", "_rights"))
    members = stored(members.select("bucket", "_cell", "id", "component", F.explode(places).alias("p")).select("bucket", "_cell", "p.*", "id", "component"), "places")
    wanted = stored(members.select("id").distinct(), "wanted")
    (of,) = inner(docs, "of")
    some = docs.join(_small(wanted.withColumnRenamed("id", of)), F.col(key).cast("long") == F.col(of), "left_semi")
    with small_batches(docs.sparkSession):
        sets = stored(full_sets(some, text, key).dropDuplicates(["id"]), "full_sets")

    def compare(table):
        batch = table.combine_chunks().to_batches()[0]
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        left, id_, component = column("left").to_numpy(zero_copy_only=False), column("id").to_numpy(), column("component").to_numpy()
        own = [np.frombuffer(x, np.uint64) for x in column("shingles").to_pylist()]
        x, y = np.flatnonzero(left), np.flatnonzero(~left)
        found = _links_between([own[i] for i in x], [own[i] for i in y], percent) if len(x) and len(y) else np.zeros((0, 2), int)
        a, b = x[found[:, 0]], y[found[:, 1]]
        other = component[a] != component[b]
        a, b = a[other], b[other]
        joins = _joining(list(zip(component[a].tolist(), component[b].tolist(), strict=True)))
        a, b = id_[a[joins]], id_[b[joins]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    grid = members.join(sets, "id").select("bucket", "_cell", "i", "j", "left", "id", "component", "shingles")
    return stored(grid.groupBy("bucket", "_cell", "i", "j").applyInArrow(compare, "a long, b long"), "second_links")


def near_duplicates(docs: DataFrame, percent: int = 85, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, n_shingles, component_id, kept of every row of ``docs``.

    Links join documents whose similarity is at least ``percent`` / 100. A null or empty text, or one of white space
    only, has no shingle and no link. A text with fewer words than a shingle is one shingle. Rows of one id are one
    document to the links; a row without id has none, and is kept. An empty table gives none. Ids are integers. Sets of
    equal size and equal 128-bit fingerprint count as equal; all other links are confirmed shingle by shingle, by 64-bit hashes.
    """
    with small_batches(docs.sparkSession):
        sets = stored(shingle_sets(docs, text, key), "sets")
    narrow = sets.select("id", "n_shingles", "f1", "f2")
    classes = sets.where("n_shingles > 0 AND id IS NOT NULL").groupBy("f1", "f2", F.col("n_shingles").alias("n"))
    classes = stored(classes.agg(F.min("id").alias("id"), F.first("signature").alias("signature")), "classes")
    rows = _buckets(classes)
    sizes = stored(rows.groupBy("bucket").agg(F.count("*").alias("_mates")).where("_mates > 1"), "sizes")
    rows = stored(rows.join(_small(sizes), "bucket"), "mates")
    # the member with the most mates over all its buckets leads: the text that others are variants of, if there is one
    mates = stored(rows.groupBy("id").agg(F.sum("_mates").alias("_all")), "all_mates")
    leads = rows.join(_small(mates), "id").groupBy("bucket").agg(F.max(F.struct("_all", (-F.col("id")).alias("minus"), "n")).alias("_lead"))
    leads = stored(leads.select("bucket", (-F.col("_lead.minus")).alias("a"), F.col("_lead.n").alias("_na")), "leads")
    met = rows.join(_small(leads), "bucket").where(F.col("id") != F.col("a"))
    met = stored(met.groupBy("a", F.col("id").alias("b")).agg(F.first("n").alias("n"), F.first("_na").alias("_na")), "met")
    pairs = stored(met.where(100 * F.least("n", "_na") >= percent * F.greatest("n", "_na")).select("a", "b"), "pairs")
    links = _confirmed(pairs, docs, text, key, percent)
    more = _second_links(rows.select("bucket", "id", "n"), components(links), docs, text, key, percent)
    labels = components(links.union(more))
    known = classes.select("f1", "f2", "id").join(_small(labels), "id", "left")
    known = stored(known.select("f1", "f2", F.coalesce("component", "id").alias("component")), "known")
    out = narrow.join(_small(known), ["f1", "f2"], "left")
    component = F.coalesce("component", "id")
    component = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), component).otherwise(F.col("id"))
    kept = F.coalesce(component == F.col("id"), F.lit(True))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), kept.alias("kept"))
