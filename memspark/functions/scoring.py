"""Confidence, freshness and ranking formulas as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prior trust in a source, by its exact type; any other has 0.6.
SOURCE_PRIORS = {
    "user": 0.9, "stated": 0.9, "manual": 0.9, "explicit": 0.9, "decision": 0.8, "curated": 0.8, "reflection": 0.7, "capture": 0.6, "transcript": 0.6,
    "agent": 0.6, "session": 0.6, "import": 0.6, "imported": 0.6, "tool": 0.5, "inferred": 0.5, "heuristic": 0.5,
}
# Shape and scale (hours) of a category's Weibull decay.
DECAY = {
    "preference": (0.4, 4380.0), "convention": (0.5, 4380.0), "architecture": (0.6, 2160.0), "pattern": (0.6, 1680.0), "learned": (0.7, 1440.0),
    "dependency": (0.75, 2160.0), "decision": (1.0, 720.0), "risk": (1.0, 720.0), "general": (1.0, 720.0), "gotcha": (0.9, 480.0),
    "blocker": (1.1, 336.0), "progress": (1.2, 168.0),
}
OTHER_DECAY = (1.0, 720.0)
CORROBORATION = 0.7


def _lookup(x: Column, table: dict, other: float) -> Column:
    out = F
    for key, value in table.items():
        out = out.when(x == key, F.lit(value))
    return out.otherwise(F.lit(other))


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def source_prior(source_type: Column) -> Column:
    return _lookup(source_type, SOURCE_PRIORS, 0.6)


def calibrated(prior: Column, mentions: Column) -> Column:
    """1 - (1 - prior) * 0.7 ^ (mentions - 1): every further mention closes a part of the gap to certainty."""
    return clamp(1 - (1 - clamp(prior)) * F.pow(F.lit(CORROBORATION), F.greatest(mentions, F.lit(1)) - 1))


def uncertainty(confidence: Column) -> Column:
    return clamp(1 - 2 * F.abs(clamp(confidence) - 0.5))


def review_priority(confidence: Column, evidence: Column) -> Column:
    return uncertainty(confidence) * (1 + F.log1p(evidence))


def weibull(age_hours: Column, shape: Column, scale: Column) -> Column:
    """exp(-(age / scale) ^ shape); a missing or negative age is fresh."""
    fresh = age_hours.isNull() | F.isnan(age_hours) | (age_hours <= 0)
    return F.when(fresh, 1.0).otherwise(F.exp(-F.pow(F.greatest(age_hours, F.lit(0.0)) / scale, shape)))


def category_freshness(category: Column, age_hours: Column) -> Column:
    shape = _lookup(category, {k: v[0] for k, v in DECAY.items()}, OTHER_DECAY[0])
    scale = _lookup(category, {k: v[1] for k, v in DECAY.items()}, OTHER_DECAY[1])
    return weibull(age_hours, shape, scale)


def reuse_salience(n: Column, age_hours: Column) -> Column:
    """v * (0.6 + 0.4 r): v grows with the log of the uses up to 8, r fades with a week since the last."""
    v = clamp(F.log1p(n) / F.log1p(F.lit(8.0)))
    return F.when(n == 0, 0.0).otherwise(clamp(0.6 * v + 0.4 * v * weibull(age_hours, F.lit(1.0), F.lit(168.0))))


def temporal_term(recency: Column, salience: Column) -> Column:
    return clamp(0.6 * recency + 0.4 * salience)


def bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 when the lengths differ or a norm is 0."""

    def of(p: Column) -> Column:
        x, y = p["a"], p["b"]
        dot = F.aggregate(F.zip_with(x, y, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
        return bound(_norm(x) * _norm(y), lambda n: F.when((F.size(x) != F.size(y)) | (n == 0), 0.0).otherwise(dot / n))

    return bound(F.struct(a.alias("a"), b.alias("b")), of)


def normalised(v: Column) -> Column:
    """The vector over its length; a zero vector as it is."""
    return bound(v, lambda w: bound(_norm(w), lambda n: F.transform(w, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))))


def text_boost(query: Column, title: Column, snippet: Column) -> Column:
    """What a result gains for holding the query: title equal .020, else in title .012, in snippet .008, share of terms .006 and .004."""
    ascii_low = lambda x: F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.filter(F.split(ascii_low(query), "[^a-z0-9]+"), lambda x: x != "")

    def of(p: Column) -> Column:
        q, t, s, w = p["q"], p["t"], p["s"], p["w"]
        share = lambda where: F.size(F.filter(w, lambda x: F.contains(where, x))) / F.size(w)
        whole = F.when(t == q, 0.020).when(F.contains(t, q), 0.012).otherwise(0.0) + F.when(F.contains(s, q), 0.008).otherwise(0.0)
        part = F.when(F.size(w) > 0, 0.006 * share(t) + 0.004 * share(s)).otherwise(0.0)
        return F.when(q == "", 0.0).otherwise(whole + part)

    # a text is lowered once, however many terms are looked up in it
    return bound(F.struct(ascii_low(F.trim(query)).alias("q"), ascii_low(title).alias("t"), ascii_low(snippet).alias("s"), terms.alias("w")), of)


def score4(x: Column) -> Column:
    """Rounded to four decimals; what is no number is 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.round(x, 4))


def discount(rank: Column) -> Column:
    """1 / log2(rank + 1) for ranks from 1."""
    return 1 / F.log2(rank + 1)
