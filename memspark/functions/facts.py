"""Conflict and arbitration rules over facts as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attributes that hold one value, and those that hold many.
SINGLE = "employer timezone marital_status status owner location city country version state priority stage manager".split()
MULTI = "tag tags language speaks_language skill skills member members visited alias aliases label labels dependency depends_on uses".split()
# Spellings of one attribute.
SYNONYMS = {"works_at": "employer", "works_for": "employer", "company": "employer", "current_employer": "employer", "tz": "timezone", "located_in": "location", "based_in": "location"}
EPSILON = 1e-9


def normal_value(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def normal_key(x: Column) -> Column:
    return F.lower(F.trim(x))


def normal_predicate(x: Column) -> Column:
    plain = F.translate(F.lower(F.trim(x)), " -", "__")
    out = F
    for spelling, name in SYNONYMS.items():
        out = out.when(plain == spelling, F.lit(name))
    return out.otherwise(plain)


def cardinality(predicate: Column) -> Column:
    p = normal_predicate(predicate)
    return F.when(p.isin(SINGLE), "single").when(p.isin(MULTI), "multi").otherwise("unknown")


def key_conflict(old: Column, new: Column) -> Column:
    return (F.trim(new) != "") & (normal_key(old) == normal_key(new))


def slot_verdict(subject_a: Column, predicate_a: Column, value_a: Column, subject_b: Column, predicate_b: Column, value_b: Column) -> Column:
    """auto_supersede, no_conflict or review for a fact b that meets a fact a."""
    other = (normal_value(subject_a) != normal_value(subject_b)) | (normal_predicate(predicate_a) != normal_predicate(predicate_b))
    kind = cardinality(predicate_b)
    return (
        F.when(other | (normal_value(value_a) == normal_value(value_b)) | (kind == "multi"), "no_conflict").when(kind == "single", "auto_supersede").otherwise("review")
    )


def parsed_time(x: Column) -> Column:
    """Six numbers of a timestamp text, offsets ignored; null with fewer than three."""
    numbers = F.transform(F.filter(F.split(x, "[^0-9]+"), lambda p: p != ""), lambda p: p.cast("long"))
    padded = F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), 6)), 1, 6)
    return F.when(F.size(numbers) >= 3, padded)


def temporal_relation(old: Column, new: Column) -> Column:
    a, b = parsed_time(old), parsed_time(new)
    return F.when(b > a, "succession").when(b == a, "concurrent").otherwise("unknown")


def trust_tier(source_type: Column) -> Column:
    """3 for manual or human, 2 for transcript or decision, as whole tokens; else 1."""
    tokens = F.split(F.lower(source_type), "[^a-z0-9]+")
    has = lambda *names: F.arrays_overlap(tokens, F.array(*map(F.lit, names)))
    return F.when(has("manual", "human"), 3).when(has("transcript", "decision"), 2).otherwise(1)


def arbitrate(old_from: Column, old_source: Column, old_confidence: Column, new_from: Column, new_source: Column, new_confidence: Column) -> Column:
    """struct(winner, basis): source tier, then recency, then confidence."""
    was, now = trust_tier(old_source), trust_tier(new_source)
    a, b = parsed_time(old_from), parsed_time(new_from)
    say = lambda winner, basis: F.struct(F.lit(winner).alias("winner"), F.lit(basis).alias("basis"))
    return (
        F.when(was > now, say("review", "source_priority"))
        .when(now > was, say("incoming", "source_priority"))
        .when(b > a, say("incoming", "recency"))
        .when(b < a, say("trusted", "recency"))
        .when(new_confidence > old_confidence + EPSILON, say("incoming", "confidence"))
        .when(old_confidence > new_confidence + EPSILON, say("trusted", "confidence"))
        .otherwise(say("review", "tie"))
    )
