"""Best-fit packing of tokenised documents into sequences of bounded length.

1. Tokenise (Arrow batches, words remembered) and cut documents longer than a sequence into full pieces and a rest.
2. Count the pieces of each length: at most ``capacity`` numbers, whatever the corpus.
3. Plan on that histogram. Pieces above a third of the capacity are large: at most two share a sequence, so each class of
   equal large pieces is matched with the longest large pieces that still fit. Smaller pieces, longest first, go to
   the smallest gap that holds them. Sequences with the same content are planned as one run, so the plan's
   size follows the number of lengths, not of documents.
4. Number the pieces within each length, by salted counts so that a length that many documents share is spread over
   tasks, and look up each number's place in the plan.
"""

from __future__ import annotations

import bisect
import math
import os
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.bpe import WordMerges
from memspark.llm.store import stored
from memspark.llm.textbatch import Words, distinct, joined, slices, small_batches, tidy

#: Most remembered odd words of a worker (beyond it the table starts anew; results don't change), and their longest, in bytes.
MOST_WORDS, REMEMBERED = 300_000, 64
#: Bytes of texts that are worked on together.
SLICE = 1 << 20
#: Pieces of a length that are numbered together, at least; it grows with the square root of all pieces.
SALT_ROWS = 200


class WordIds:
    """Ids of words, runs of bytes other than white space below 0x21.

    The vocabulary cuts at white space before anything else, and lower-cases character by character; so a text's ids are
    those of its words, unless special strings may be inside: such texts go to the library whole. The distinct words of
    a slice are merged all at once; those of other characters than the usual ones go to the library one by one.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel part
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges = WordMerges(path)
        self.end = np.array([end_id], np.int32)
        self.odd: dict[bytes, np.ndarray] = {}

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def others(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words that the merges leave out."""
        if len(self.odd) > MOST_WORDS:
            self.odd.clear()
        found = {w: self.odd[w] for w in words if w in self.odd}
        unknown = [w for w in words if w not in found]
        found.update(zip(unknown, self.encoded([w.decode() for w in unknown]), strict=True))
        self.odd.update((w, found[w]) for w in unknown if len(w) <= REMEMBERED)
        return [found[w] for w in words]

    def of_words(self, data: np.ndarray, offsets: np.ndarray, tails: dict[int, np.ndarray], end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts of a slice: of their words, and then of what ``tails`` has for the text, or ``end``."""
        words = Words(data, offsets)
        first, index = distinct(words)
        ids, size, out = self.merges.words(joined(words, first))
        values, n = [ids], len(size)
        more = [*self.others([data[a:b].tobytes() for a, b in zip(words.start[first[out]].tolist(), words.end[first[out]].tolist(), strict=True)]), end, *tails.values()]
        size = np.append(size, [len(v) for v in more[len(out) :]])
        size[out] = [len(v) for v in more[: len(out)]]
        start = np.cumsum(size) - size
        # where words were left out, their ids stand at the end
        inside = np.ones(n, bool)
        inside[out] = False
        start[:n][inside] = np.cumsum(size[:n][inside]) - size[:n][inside]
        behind = np.append(out, np.arange(n, len(size)))
        start[behind] = len(ids) + np.cumsum(size[behind]) - size[behind]
        flat = np.concatenate([*values, *more])
        tail = np.full(len(offsets) - 1, n)
        tail[list(tails)] = n + 1 + np.arange(len(tails))
        items = np.insert(index, words.first[1:], tail)
        many = size[items]
        until = np.cumsum(many)
        found = flat[np.repeat(start[items] - (until - many), many) + np.arange(until[-1])]
        return found.astype("<u4"), np.concatenate([[0], until[words.first[1:] + np.arange(len(tail))]])

    def of_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts of a slice, each with the end id."""
        bars = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        tails = {}
        if len(bars):
            data = data.copy()
        for i in np.unique(np.searchsorted(offsets, bars, "right") - 1).tolist():
            here = slice(offsets[i], offsets[i + 1])
            tails[i] = np.append(self.encoded([data[here].tobytes().decode()])[0], self.end)
            data[here] = 0x20  # no words are left here
        if len(data) <= 2 * SLICE:
            return self.of_words(data, offsets, tails, self.end)
        # one long text: parts that end at white space
        spaces, cuts = np.flatnonzero(data == 0x20), [0]
        while len(data) - cuts[-1] > SLICE and (k := np.searchsorted(spaces, cuts[-1] + SLICE)) < len(spaces):
            cuts.append(int(spaces[k]) + 1)
        none = self.end[:0]
        parts = [self.of_words(data[a:b], np.array([0, b - a]), {}, none)[0] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)]
        ids = np.concatenate([*parts, tails.get(0, self.end).astype("<u4")])
        return ids, np.array([0, len(ids)])


_word_ids: dict[tuple[str, int], WordIds] = {}


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, piece, start, length and ids_crc32 of every piece; a document is its ids and then ``end_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _word_ids.get((path, end_id)) or _word_ids.setdefault((path, end_id), WordIds(path, end_id))
        for batch in batches:
            for part, data, offsets in slices(batch, "_text", SLICE):
                ids, at = known.of_slice(data, offsets)
                n = -(-np.diff(at) // capacity)
                row = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = number * capacity
                length = np.minimum(np.diff(at)[row] - start, capacity)
                raw, lo = memoryview(ids.tobytes()), 4 * (at[:-1][row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), (lo + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=[key, "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias(key), docs[text].alias("_text"))
    return rows.mapInArrow(tidy(run), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


class Run(NamedTuple):
    """Pieces ``lo`` to ``lo + each * sequences - 1`` of a length: ``each`` of them side by side from ``offset`` on in every sequence from ``first`` on."""

    length: int
    lo: int
    sequences: int
    each: int
    first: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Places for ``counts[length]`` pieces of every length from 1 to ``capacity``."""
    left, used, runs, total = {k: n for k, n in counts.items() if n > 0}, dict.fromkeys(counts, 0), [], 0
    gaps: list[int] = []  # ascending; open[gap]: runs of sequences (first, number) with that much space
    opened: dict[int, list[tuple[int, int]]] = {}

    def put(length: int, sequences: int, each: int, first: int, offset: int) -> None:
        runs.append(Run(length, used[length], sequences, each, first, offset))
        used[length] += sequences * each
        left[length] -= sequences * each

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in opened:
                bisect.insort(gaps, gap)
            opened.setdefault(gap, []).append((first, number))

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            mates = [k for k in large[: bisect.bisect_right(large, min(capacity - length, length))] if left[k]]
            mate = mates[-1] if mates else None
            if mate == length and left[length] == 1:
                mate = mates[-2] if len(mates) > 1 else None
            if mate is None:
                n = left[length]
                put(length, n, 1, total, 0)
                leave(capacity - length, total, n)
            elif mate == length:
                n = left[length] // 2
                put(length, n, 2, total, 0)
                leave(capacity - 2 * length, total, n)
            else:
                n = min(left[length], left[mate])
                put(length, n, 1, total, 0)
                put(mate, n, 1, total, length)
                leave(capacity - length - mate, total, n)
            total += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):  # new sequences, each filled before the next
                each = capacity // length
                new = max(1, left[length] // each)
                leave(capacity, total, new)
                total += new
                continue
            gap = gaps[at]
            first, number = opened[gap].pop()
            if not opened[gap]:
                del opened[gap], gaps[at]
            each = min(gap // length, left[length])
            n = min(number, left[length] // each)
            put(length, n, each, first, capacity - gap)
            leave(gap - each * length, first, n)
            leave(gap, first + n, number - n)
    return runs


def pack(docs: DataFrame, path: str, capacity: int, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Every piece of ``docs`` with its place: ``key``, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds the end id only. Repeated rows are packed each for itself; pieces that
    agree in all columns may swap places. An empty table gives no row. Other columns of ``docs`` don't pass.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        found = stored(pieces(docs, path, capacity, end_id, text, key), "pieces")
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    together = max(SALT_ROWS, math.isqrt(sum(counts.values())))
    salts = spark.createDataFrame([(k, -(-n // together)) for k, n in counts.items()], "length long, _salts long")
    salted = found.join(F.broadcast(salts), "length").withColumn("_salt", F.pmod(F.xxhash64(key, "piece"), "_salts")).drop("_salts")
    # a row for each length and salt; the numbers of a length's salts follow one another
    cells = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(cells.withColumn("_from", F.coalesce(F.sum("_n").over(w), F.lit(0))), "cells")
    runs = plan(counts, capacity)
    by_length: dict[int, list[Run]] = {}
    for r in runs:
        by_length.setdefault(r.length, []).append(r)
    table = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast(table)  # bounded by the capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_number"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
                _, lo, _, each, first, base = shared.value[int(length[rows[0]])]
                r = np.searchsorted(lo, number[rows], "right") - 1
                inside = number[rows] - lo[r]
                sequence[rows] = first[r] + inside // each[r]
                offset[rows] = base[r] + inside % each[r] * length[rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    inner = Window.partitionBy("length", "_salt").orderBy(key, "piece", "ids_crc32")
    numbered = salted.withColumn("_rank", F.row_number().over(inner) - 1).join(cells.drop("_n"), ["length", "_salt"])
    numbered = numbered.select(key, "piece", "start", "length", "ids_crc32", (F.col("_from") + F.col("_rank")).alias("_number"))
    kind = docs.schema[key].dataType.simpleString()
    return numbered.mapInArrow(tidy(place), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
