"""Spelling variants: words within one edit of each other, and the form that most writers use.

A word is a multiset of letters; as a binary vector it has a place for every letter and count (the first e, the second e,
...). One edit changes at most two places, so words within one edit have vectors at a Hamming distance of two at most. Such
pairs are found by partition and enumeration: the places are dealt into PARTS parts, and two vectors that differ in two
places agree on all but two parts. A word has a signature for each choice of PARTS - 2 parts, with what its vector holds in
them; words that share a signature are compared. No pair is lost.

Lengths of the two words differ by one at most, so a signature belongs to a length: a word gives its signatures for its own
length and for the next one (as the shorter word of a pair). Words that agree in letters but not in their order meet in vain,
so the words of a signature are told apart by order as well: one edit leaves the first or the last half of the shorter word
where it is, and only words that agree on such a half are compared. Copies of a pair, from several signatures, are one.

Words are counted in two steps: each batch of texts is reduced to its distinct words before they are shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.store import stored
from memspark.llm.textbatch import slices, small_batches, tidy

LEAST_LENGTH, LEAST_COUNT, ONE_IN = 5, 3, 97
#: Parts that the places are dealt into; signatures leave two of them out.
PARTS = 4
#: Rows of a batch of texts, and distinct words that a task holds before it gives them on.
BATCH_ROWS, HELD = 1_000, 200_000
_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")
_LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def damaged_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """word, n: the distinct runs of letters of every batch of texts, in lower case from A to Z, with one in ONE_IN cut by a letter.

    Which are cut, and where, follows the crc32 of key and run. A null key counts as the empty text.
    """

    def given(seen: Counter) -> pa.RecordBatch:
        words = [w for w in seen if len(w) >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([seen[w] for w in words], pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for part, data, offsets in slices(batch, "_text"):
                low = data.tobytes().translate(_LOW)
                for i, key_ in enumerate(part.column(0).to_pylist()):
                    start = crc32(f"{'' if key_ is None else key_}:".encode())
                    for word, n in Counter(_RUN.findall(low[offsets[i] : offsets[i + 1]].decode())).items():
                        h = crc32(word.encode(), start)
                        if not h % ONE_IN:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        seen[word] += n
                if len(seen) > HELD:
                    yield given(seen)
                    seen = Counter()
        yield given(seen)

    return docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text")).mapInArrow(tidy(run), "word string, n long")


def signatures(word: str) -> list[tuple[bool, str]]:
    """The signatures of a word; True where it stands for the shorter word of a pair, or for one of two as long as each other."""
    held: list[list[str]] = [[] for _ in range(PARTS)]
    for letter, n in sorted(Counter(word).items()):
        for nth in range(n):
            held[(ord(letter) + nth) % PARTS].append(f"{letter}{nth}")
    parts = ["".join(p) for p in held]
    chosen = ["".join(f"|{p}:{parts[p]}" for p in some) for some in combinations(range(PARTS), PARTS - 2)]
    found = []
    for short in (len(word), len(word) - 1):
        half = short // 2
        halves = f"{short}<{word[:half]}", f"{short}>{word[len(word) - (short - half) :]}"
        found.extend((short == len(word), h + c) for h in halves for c in chosen)
    return found


def _signed(words: DataFrame) -> DataFrame:
    """word, own, k: a hash of each signature of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in (batch.slice(i, 2_000) for i in range(0, batch.num_rows, 2_000)):
                found = [(i, *s) for i, word in enumerate(some.column(0).to_pylist()) for s in signatures(word)]
                of, own, keys = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of, pa.int64())), pa.array(own, pa.bool_()), pa.array(keys, pa.string())], names=["word", "own", "k"])

    return words.select("word").mapInArrow(tidy(run), "word string, own boolean, k string").select("word", "own", F.xxhash64("k").alias("k"))


def near_words(words: DataFrame) -> DataFrame:
    """word, other: every pair of different words of ``words`` (word) within one edit, in both orders."""
    signed = stored(_signed(words), "spelling_signatures")
    # a signature of one word joins nothing
    met = signed.groupBy("k").agg(F.count("*").alias("c")).where("c > 1").select("k")
    signed = stored(signed.join(met, "k", "left_semi"), "spelling_shared")
    left = signed.where("own").select("k", F.col("word").alias("a"))
    right = signed.select("k", F.col("word").alias("b"), "own")
    pairs = left.join(right, "k").where((F.col("a") < F.col("b")) | (~F.col("own") & (F.col("a") != F.col("b"))))
    pairs = pairs.where(F.levenshtein("a", "b", 1) == 1).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other")))).alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of ``forms`` (word, form) lead. A form is twice as common as its word, so ways are short and end."""
    found = stored(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = stored(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        if not found.where("moved").limit(1).count():
            return found.select("word", "root")
        found = found.select("word", "root")


def variants(counts: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word that ``counts`` (word, n; a word may have several rows) holds ``least`` times.

    A word's form is the most common word within one edit, the first in code-point order of equal ones, if it is at least twice as common;
    its root is where forms lead. A word without a form has none, no form_n, and is its own root. Null words aren't counted. No row gives none.
    """
    words = counts.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = stored(words, "spelling_words")
    near = near_words(words).join(words.select(F.col("word").alias("other"), F.col("n").alias("m")), "other")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.other").alias("other"), (-F.col("best.m")).alias("m"))
    has = F.col("m") >= 2 * F.col("n")
    found = stored(found.select("word", "n", "n_near", F.when(has, F.col("other")).alias("form"), F.when(has, F.col("m")).alias("form_n")), "spelling_forms")
    roots = _roots(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The ``variants`` of the damaged runs of all texts of ``docs``. A null or empty text has no words; repeated rows count again; other columns aren't read."""
    with small_batches(docs.sparkSession, BATCH_ROWS):
        counts = stored(damaged_runs(docs, text, key).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT), "spelling_counts")
    return variants(counts)
