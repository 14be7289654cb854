"""Arrow batches of texts as numpy arrays: slices of bounded size, word boundaries and word hashes.

Everything here works on a whole slice of texts at once, so that a task's memory follows the slice (or one text, if that
is longer), not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit values without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit constants that depend only on ``seed``."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTE = constants(256, 11)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept up to the length of a slice."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        found = np.full(max(n, SLICE_BYTES), base, np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = found
    return found[:n]


def release() -> None:
    """Gives what the arrays of an earlier batch took back to the system: a worker lives on between tasks, beside others."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose task leaves no memory behind in the worker."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000) -> Iterator[None]:
    """Batches of ``rows`` rows for what is written meanwhile: long texts make large batches, on both sides of the pipe."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(was)) if int(was) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive parts of ``batch`` with (bytes, offsets) of their texts; nulls count as empty.

    A part has at most ``most`` bytes of text, or one row.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    release()
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def strings(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Consecutive parts of ``batch`` with their texts as Python strings; nulls count as empty."""
    for part, _, _ in slices(batch, column, most):
        yield part, [t or "" for t in part.column(part.schema.get_field_index(column)).to_pylist()]


class Words:
    """Word boundaries of a slice: words are runs of bytes that are not in the table ``outside``: by default 0x20 and 0x09 to 0x0D.

    ``start``, ``end``: byte bounds of each word; ``first``: index of each text's first word, with the total at the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _SPACE):
        self.data, self.offsets = data, offsets
        space = outside[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inside = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[inside] = True
        after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = True
        self.start = np.flatnonzero(~space & before)
        self.end = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word with A-Z in lower case."""
        if not len(self.data):
            return np.zeros(0, np.uint64)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[self.data]] * powers(_BASE, len(self.data)), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * powers(_INVERSE, len(self.data))[self.start])


_LANE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first, index): a place of each distinct word of a slice, and which of these each word is. A word may be listed twice.

    Words of 16 bytes or less are compared by their length and their bytes as two numbers, longer ones by a dictionary of the slice.
    """
    start, size = words.start, words.end - words.start
    raw = words.data.tobytes() + bytes(16)
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    a = lanes[start] & _LANE[np.minimum(size, 8)]
    b = lanes[start + 8 * (size > 8)] & _LANE[np.clip(size - 8, 0, 8)]
    long = np.flatnonzero(size > 16)
    if len(long):
        codes: dict[bytes, int] = {}
        a[long] = [codes.setdefault(raw[x:y], len(codes)) for x, y in zip(start[long].tolist(), words.end[long].tolist(), strict=True)]
        b[long] = ~np.uint64(0)  # no text has such bytes
    order = np.argsort(mix(a * constants(1, 17) + b * constants(1, 19) + size.astype(np.uint64)))
    a, b, size = a[order], b[order], size[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (size[1:] != size[:-1])
    index = np.empty(len(a), np.int64)
    index[order] = np.cumsum(new) - 1
    return order[new], index


def joined(words: Words, which: np.ndarray) -> bytes:
    """The words at places ``which``, each with a space after it."""
    start, size = words.start[which], words.end[which] - words.start[which]
    before = np.cumsum(size) - size
    at = np.arange(size.sum())
    out = np.full(len(at) + len(which), 0x20, np.uint8)
    out[at + np.repeat(np.arange(len(which)), size)] = words.data[at + np.repeat(start - before, size)]
    return out.tobytes()


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct ``n``-word shingles in ascending order.

    A text with fewer words gives its whole word sequence as one shingle, a text without words none.
    """
    h, first, count = words.hashes(), words.first, words.counts()
    text = words.text()
    c = constants(n, 29)
    at = np.arange(len(h))
    full = at + n <= np.repeat(first[1:], count)
    full = at[full]
    out = np.zeros(len(full), np.uint64)
    for k in range(n):
        out += h[full + k] * c[k]
    few = np.flatnonzero((count > 0) & (count < n))
    short = np.zeros(len(few), np.uint64)
    for k in range(n - 1):
        has = count[few] > k
        short[has] += h[first[:-1][few][has] + k] * c[k]
    short = mix(short + count[few].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    of, value = np.concatenate([text[full], few]), np.concatenate([mix(out), short])
    order = np.lexsort((value, of))
    of, value = of[order], value[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    of, value = of[new], value[new]
    return value, np.searchsorted(of, np.arange(len(words.offsets)))


def text_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values``, one for each byte or word, over texts bounded by ``offsets``; empty texts give 0."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def byte_table(characters: str | bytes) -> np.ndarray:
    """A table of 256 flags, set for the bytes of ``characters``."""
    out = np.zeros(256, bool)
    out[list(characters.encode() if isinstance(characters, str) else characters)] = True
    return out
