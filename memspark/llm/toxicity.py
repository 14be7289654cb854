"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

Words are runs of letters and digits in lower case, with digits and signs that stand for letters undone. A lexicon of
weighted words and stems is learned from labelled texts: words that toxic texts have far more often than others. The features are
densities of the lexicon's words and of a fixed list of insults, how near they stand to second-person words, and rates
of capitals, punctuation and obfuscation. The trees are Spark's gradient-boosted trees; isotonic regression on labelled rows
that they haven't seen (unless a part lacks a label) makes their output a probability.

Lexicon and trees are learned from a bounded sample (``most`` rows of each label); every document is scored, in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.names import inner
from memspark.llm.samples import sample
from memspark.llm.store import stored
from memspark.llm.textbatch import Words, byte_table, slices, text_sums, tidy

#: Most rows of each label that are learned from; words of the lexicon; texts that must have a word.
SAMPLE, LEXICON, LEAST_TEXTS = 4_000, 600, 3
#: Bytes of a word's stem, which the lexicon may hold besides whole words.
STEM = 4
TREES, DEPTH = 20, 3
#: Words within this distance of a second-person word count as aimed at a person.
NEAR = 5
# Common insults and second-person words.
INSULTS = (
    "idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown fool jerk ugly garbage hate kill shut fat lame freak creep "
    "imbecile bastard bitch damn crap hell sucks vermin coward liar parasite filth lunatic psycho retard whore slut"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre usted tú ti tus vosotros".split()

_LETTERS = np.ones(256, bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256), ord("@"), ord("$"), ord("*")]] = False
_UPPER, _DIGIT, _LOUD, _ASK, _STAR = (byte_table(x) for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "?", "*@$"))
_MARK = byte_table(".,;:!?\"'()-")
_PLAIN = np.arange(256, dtype=np.uint8)
for _sign, _letter in zip(b"013457@$", b"oieastas", strict=True):
    _PLAIN[_sign] = _letter
FEATURES = 14


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words, the hashes of them and of their stems with stand-in signs undone, and whether a word mixes such signs with letters."""
    words = Words(data, offsets, _LETTERS)
    start, end = words.start, words.end
    sums = np.concatenate([[0], np.cumsum(_STAR[data] | _DIGIT[data], dtype=np.int64)])
    signs = sums[end] - sums[start]
    mixed = (signs > 0) & (signs < end - start)
    words.data = _PLAIN[data]
    h = words.hashes()
    words.end = np.minimum(end, start + STEM)
    stems = np.where(end - start > STEM, words.hashes() ^ np.uint64(0x5555555555555555), h)
    words.end = end
    return words, h, stems, mixed


def _hashes(texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    return _words(np.frombuffer(b"".join(raw), np.uint8), offsets)[1]


class Lexicon(NamedTuple):
    """Word hashes in ascending order, and their weights."""

    words: np.ndarray
    weights: np.ndarray

    def of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.zeros(len(h))
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.weights[at], 0.0)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """(texts, FEATURES) measures of a slice; an empty text has zeros."""
    words, h, stems, mixed = _words(data, offsets)
    n, size = np.maximum(words.counts(), 1), np.maximum(np.diff(offsets), 1)
    weight = np.maximum(lexicon.of(h), lexicon.of(stems))
    insult = np.isin(h, _INSULTS)
    person = np.isin(h, _PERSONS)
    hit = (weight > 0) | insult
    reach = np.concatenate([[0], np.cumsum(person)])
    text = words.text()
    lo, hi = np.maximum(np.arange(len(h)) - NEAR, words.first[:-1][text]), np.minimum(np.arange(len(h)) + NEAR + 1, words.first[1:][text])
    near = hit & (reach[hi] > reach[lo])
    per = lambda x: text_sums(x, words.first)
    hits = per(weight > 0)
    weighed = per((weight * 1000).astype(np.int64)) / 1000
    length = words.end - words.start
    of = lambda t: text_sums(t[data], offsets)
    out = [
        hits / n, np.log1p(hits), weighed / n, np.log1p(weighed), per(insult) / n, np.log1p(per(insult)), per(near) / n, np.log1p(per(near)),
        of(_UPPER) / size, of(_LOUD) / n, of(_ASK) / n, of(_MARK) / n, per(mixed) / n, per(length > 25) / n,
    ]
    return np.stack(out, axis=1)


_INSULTS, _PERSONS = _hashes([f"{w} " for w in INSULTS]), _hashes([f"{w} " for w in SECOND_PERSON])


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """The words of ``rows`` (_text, _toxic) with the largest weighted log odds between toxic and other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "_text"):
                words, h, stems, _ = _words(data, offsets)
                text, h = np.tile(words.text(), 2), np.concatenate([h, stems])
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
                toxic = part.column(1).to_numpy(zero_copy_only=False)[text[new]]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(toxic.astype(np.int64))], names=["h", "toxic"])

    total = rows.agg(F.sum("_toxic"), F.count("*")).first()
    toxic, other = (total[0] or 0), total[1] - (total[0] or 0)
    if not toxic or not other:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    seen = rows.select("_text", "_toxic").mapInArrow(tidy(run), "h long, toxic long").groupBy("h").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    seen = seen.where(F.col("a") >= LEAST_TEXTS)
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("a") + 0.5) / (other + 1.0))
    top = seen.select("h", odds.alias("odds"), (odds * F.sqrt("a")).alias("order")).where("odds > 2")
    found = top.orderBy(F.col("order").desc(), "h").limit(LEXICON).collect()
    h = np.array([r.h for r in found], np.int64).view(np.uint64)
    order = np.argsort(h)
    return Lexicon(h[order], np.array([r.odds for r in found])[order])


def _measured(docs: DataFrame, keep: list[str], text: str, lexicon: Lexicon, name: str = "_tox_v") -> DataFrame:
    """The ``keep`` columns and the vector of features of every row, as the column ``name``, which ``docs`` doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text):
                x = features(data, offsets, lexicon)
                kept = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, name])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    columns = keep if text in keep else [*keep, text]
    return docs.select(*columns).mapInArrow(tidy(run), f"{schema}`{name}` array<double>").withColumn(name, array_to_vector(name))


class Model(NamedTuple):
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    bounds: list[float]
    values: list[float]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", most: int = SAMPLE) -> Model | None:
    """A model from ``labels`` (``key``, _toxic: 0 or 1); None unless both labels have texts.

    A half of the sample teaches the lexicon, a third the trees, a sixth the calibration: the trees see lexicon hits as they come in new text,
    and the calibration sees scores of rows that the trees don't know. Only where a part lacks a label do parts overlap.
    """
    labels = labels.where(F.col(key).isNotNull() & F.col("_toxic").isin(0, 1)).groupBy(key).agg(F.max("_toxic").cast("long").alias("_toxic"))
    sizes = {r["_toxic"]: r["n"] for r in labels.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    parts = [sample(labels.where(F.col("_toxic") == y), most, key, 3 + y) for y in (0, 1)]  # at most 2 * most rows
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(key, docs[text].alias("_text")).join(F.broadcast(chosen), key)
    # copies of a text would make its words look typical; the smallest id stands for them, so reruns agree
    rows = rows.groupBy("_toxic", "_text").agg(F.min(key).alias(key))
    rows = stored(rows.withColumn("_part", F.pmod(F.xxhash64(key, F.lit(9)), F.lit(6))), "toxicity_sample")
    lexicon = learn_lexicon(rows.where("_part < 3"))
    known = stored(_measured(rows, ["_toxic", "_part"], "_text", lexicon), "toxicity_features")
    seen = {(r["_toxic"], r["g"]) for r in known.select("_toxic", (F.col("_part") < 5).alias("g")).distinct().collect()}
    if not {(0, True), (1, True)} <= seen:
        return None
    learner = GBTClassifier(featuresCol="_tox_v", labelCol="_toxic", predictionCol="_tox_prediction", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1, minInstancesPerNode=2)
    learner.set(learner.probabilityCol, "_tox_probability")
    learner.set(learner.rawPredictionCol, "_tox_raw")
    # rows that taught the lexicon have its words more often than new text; the trees learn from others if there are enough
    both = lambda df: {r["_toxic"] for r in df.select("_toxic").distinct().collect()} == {0, 1}
    teach, check = known.where("_part BETWEEN 3 AND 4"), known.where("_part = 5")
    teach = teach if both(teach) else known
    check = check if both(check) else known.where("_part >= 3")
    trees = learner.fit(teach.coalesce(1))
    rest = trees.transform(check).select(F.col("_toxic").cast("double").alias("y"), vector_to_array("_tox_probability")[1].alias("p"))
    # rows of a label that was sampled stand for those that weren't
    stands = [max(1.0, sizes.get(y, 0) / most) for y in (0, 1)]
    rest = rest.withColumn("w", F.when(F.col("y") == 1, stands[1]).otherwise(stands[0]))
    iso = IsotonicRegression(featuresCol="p", labelCol="y", weightCol="w").fit(rest)
    return Model(lexicon, trees, list(iso.boundaries), list(iso.predictions))


def score(docs: DataFrame, model: Model | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the probability of toxicity, 0 to 1.

    A null text counts as empty and gets the empty text's score. Without a model every score is 0: nothing is known
    against any text. Repeated rows score alike; an empty table gives none. A column ``name`` of ``docs`` is replaced.
    """
    kept = [c for c in docs.columns if c != name]
    if model is None:
        return docs.select(*kept, F.lit(0.0).alias(name))
    vector, raw, probability, prediction, p = inner(docs, "vector", "raw", "probability", "prediction", "p")
    names = {"featuresCol": vector, "rawPredictionCol": raw, "probabilityCol": probability, "predictionCol": prediction}
    trees = model.trees.copy({model.trees.getParam(k): v for k, v in names.items()})
    found = trees.transform(_measured(docs, kept, text, model.lexicon, vector)).withColumn(p, vector_to_array(probability)[1])
    x, y = model.bounds, model.values
    out = F.when(F.col(p) <= x[0], y[0])
    for (a, b), (c, d) in zip(zip(x, x[1:], strict=False), zip(y, y[1:], strict=False), strict=True):
        out = out.when(F.col(p) <= b, F.lit(c) + (F.col(p) - a) / (b - a) * (d - c) if b > a else F.lit(d))
    return found.withColumn(name, F.least(F.greatest(out.otherwise(y[-1]), F.lit(0.0)), F.lit(1.0))).select(*kept, name)
