"""Quality scores by positive-unlabelled learning.

Trusted positives and unlabelled text train a small network on dense text measures. With the class prior c, the risk of
the unlabelled text as negatives less c times the risk of the positives as negatives is an unbiased estimate of the
negatives' risk; where it falls below zero the network overfits, and the non-negative estimator steps back
instead. The prior is the smallest ratio of unlabelled to positive mass above a threshold of a first
positive-against-unlabelled score, on rows that score wasn't trained on.

The sample is bounded (``most`` positives and as many unlabelled texts); every document is scored, in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.llm.samples import sample
from memspark.llm.textbatch import Words, byte_table, slices, text_sums, tidy

#: Most positives, and most unlabelled texts, that the model is trained on.
SAMPLE = 12_000
HIDDEN, STEPS, BATCH, RATE, SEED = 16, 700, 1024, 0.02, 5

_UPPER, _LOWER, _DIGIT = byte_table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_table("abcdefghijklmnopqrstuvwxyz"), byte_table("0123456789")
_SYMBOL, _LOUD, _MARK, _BAR = byte_table("#*$%&<>=+~^@_\\{}[]"), byte_table("!?"), byte_table(".,;:"), byte_table("|/")
_HIGH, _LINE = byte_table(bytes(range(0xC0, 256))), byte_table("\n")
FEATURES = 16


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, FEATURES) measures of a slice of texts, each bounded; an empty text has zeros."""
    words = Words(data, offsets)
    n = words.counts()
    size, count = np.maximum(np.diff(offsets), 1), np.maximum(n, 1)
    per = {k: text_sums(t[data], offsets) for k, t in (("upper", _UPPER), ("lower", _LOWER), ("digit", _DIGIT), ("symbol", _SYMBOL), ("loud", _LOUD), ("mark", _MARK), ("bar", _BAR), ("high", _HIGH), ("line", _LINE))}
    letters = np.maximum(per["upper"] + per["lower"] + per["high"], 1)
    h = words.hashes()
    text = words.text()
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    second = np.zeros(len(h), bool)
    second[2:] = (h[2:] == h[:-2]) & (text[2:] == text[:-2])
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = text_sums(new, words.first)
    length = words.end - words.start
    out = [
        np.log1p(n) / 8, per["upper"] / letters, np.minimum(per["symbol"] / count, 2), np.minimum(per["loud"] / count, 2), np.minimum(per["mark"] / count, 1),
        np.minimum(per["bar"] / count, 1), per["digit"] / size, per["high"] / letters, np.minimum(per["line"] / count, 1), letters / size,
        text_sums(same, words.first) / count, text_sums(second, words.first) / count, distinct / count, np.minimum(text_sums(length, words.first) / count, 20) / 10,
        text_sums(length == 1, words.first) / count, np.log1p(n) / 8 * distinct / count,
    ]
    return np.stack(out, axis=1) * (n > 0)[:, None]


class Network(NamedTuple):
    """One hidden layer over standardised measures; ``score`` is a probability."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def hidden(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w1 + self.b1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.hidden(x) @ self.w2 + self.b2, -30, 30)))


def risk(net: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk by the logistic loss: of positives, and of negatives as unlabelled less positive texts."""
    p, u = (np.clip(net.hidden(x) @ net.w2 + net.b2, -30, 30) for x in (positive, unlabelled))
    loss = lambda z: np.logaddexp(0, z)
    return float(prior * loss(-p).mean()), float(loss(u).mean() - prior * loss(p).mean())


def gradients(net: Network, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> list[np.ndarray]:
    """The step of the weights (w1, b1, w2, b2) on a batch: of the whole risk, or back from a negative part below 0.

    Without a prior the unlabelled texts simply count as negatives.
    """
    n, m = len(positive), len(unlabelled)
    x = np.concatenate([positive, unlabelled])
    h = net.hidden(x)
    s = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30)))
    # gradients of the losses by the logit: (s - 1) for a positive, s for a negative
    if prior is None:
        g = np.concatenate([(s[:n] - 1) / n, s[n:] / m])
    elif risk(net, positive, unlabelled, prior)[1] >= 0:
        g = np.concatenate([(prior * (s[:n] - 1) - prior * s[:n]) / n, s[n:] / m])
    else:
        g = -np.concatenate([-prior * s[:n] / n, s[n:] / m])
    back = g[:, None] * net.w2 * (1 - h * h)
    z = np.clip((x - net.mean) / net.scale, -6, 6)
    return [z.T @ back, back.sum(axis=0), h.T @ g, g.sum(keepdims=True)]


def _trained(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Network:
    """Adam on the logistic loss; without a prior the unlabelled texts simply count as negatives."""
    rnd = np.random.default_rng(SEED)
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(axis=0), both.std(axis=0) + 1e-3, rnd.normal(0, 0.4, (both.shape[1], HIDDEN)), np.zeros(HIDDEN), rnd.normal(0, 0.4, HIDDEN), np.zeros(1))
    slow, fast = [np.zeros_like(w) for w in net[2:]], [np.zeros_like(w) for w in net[2:]]
    for step in range(1, STEPS + 1):
        p, u = (x[rnd.integers(0, len(x), BATCH)] for x in (positive, unlabelled))
        grads = gradients(net, p, u, prior)
        rate = RATE * (1 - (step - 1) / STEPS)
        for w, d, a, b in zip(net[2:], grads, slow, fast, strict=True):
            d = d + 1e-4 * w
            a[:] = 0.9 * a + 0.1 * d
            b[:] = 0.999 * b + 0.001 * d * d
            w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in the unlabelled texts, at most: the least ratio of the masses above a threshold, with a margin for chance."""
    net = _trained(positive[0::2], unlabelled[0::2], None)
    p, u = np.sort(net.score(positive[1::2])), np.sort(net.score(unlabelled[1::2]))
    cuts = np.quantile(p, np.linspace(0, 0.9, 91))
    above_p, above_u = 1 - np.searchsorted(p, cuts) / len(p), 1 - np.searchsorted(u, cuts) / len(u)
    margin = np.sqrt(np.log(20) / (2 * len(p))) + np.sqrt(np.log(20) / (2 * len(u)))
    at = np.argmin((above_u + margin) / above_p)
    return float(np.clip(above_u[at] / above_p[at], 0.05, 0.98))


def _measured(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "_text"):
                x = features(data, offsets)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(list(x), pa.list_(pa.float64()))], names=[*extra, "x"])

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in extra)
    return docs.select(*extra, "_text").mapInArrow(tidy(run), f"{schema}x array<double>")


class Classifier(NamedTuple):
    network: Network
    prior: float


def fit(docs: DataFrame, positives: DataFrame, text: str = "text", key: str = "doc_id", most: int = SAMPLE) -> Classifier | None:
    """A classifier from the ids in ``positives`` (one column ``key``) and the texts of ``docs``; None if either is too small (under 20 rows)."""
    ids = docs.where(F.col(key).isNotNull()).select(key)
    good = sample(positives.select(key).distinct(), most, key, 1).withColumn("_positive", F.lit(True))
    some = sample(ids, most, key, 2).distinct().withColumn("_positive", F.lit(False))
    chosen = good.unionByName(some)  # at most 2 * most rows
    rows = docs.select(key, docs[text].alias("_text")).join(F.broadcast(chosen), key)
    rows = rows.groupBy(key, "_positive").agg(F.min("_text").alias("_text"))  # a sampled id counts once, however many rows have it
    rows = _measured(rows, (key, "_positive")).orderBy("_positive", key).collect()
    x, y = np.array([r.x for r in rows]).reshape(len(rows), FEATURES), np.array([r["_positive"] for r in rows], bool)
    if y.sum() < 20 or (~y).sum() < 20:
        return None
    rnd = np.random.default_rng(SEED)
    positive, unlabelled = rnd.permutation(x[y]), rnd.permutation(x[~y])
    prior = class_prior(positive, unlabelled)
    return Classifier(_trained(positive, unlabelled, prior), prior)


def score(docs: DataFrame, model: Classifier | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: the probability of the positive class, 0 to 1.

    A null text counts as empty and gets the empty text's score. Without a model every score is 1: nothing is known
    against any text. Repeated rows score alike; an empty table gives none. A column ``name`` of ``docs`` is replaced.
    """
    kept = [c for c in docs.columns if c != name]
    if model is None:
        return docs.select(*kept, F.lit(1.0).alias(name))
    network = model.network

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, text):
                s = network.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64())], names=[*kept, name])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.select(*kept).mapInArrow(tidy(run), f"{schema}, `{name}` double")
