"""Text, key and scope functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = "\u001f"
# The stop list of the keyword extractor.
STOP_WORDS = (
    "a about above after again all also am an and any are as at be because been before being below between both but by "
    "can could did do does doing done down during each few for from further had has have having he her here hers him his "
    "how if in into is it its just may me might more most must my no nor not now of off on once only or other our out over "
    "own per same she should so some such than that the their them then there these they this those through to too under "
    "until up use used uses very was we were what when where which while who whom why will with would you your"
).split()
# Phrases and markers of prompt injection, in the order of the report.
INJECTION_SIGNALS = (
    "ignore previous instructions", "ignore all previous", "ignore the above", "ignore your instructions", "disregard previous",
    "disregard the above", "disregard all prior", "forget everything", "forget your instructions", "you are now", "new instructions:",
    "updated instructions:", "system prompt:", "reveal your system prompt", "print your system prompt", "ignore your guidelines",
    "override your instructions", "do not tell the user", "don't tell the user", "without telling the user", "without informing the user",
    "<|im_start|>", "<|im_end|>", "<system>", "</system>", "[system]", "<tool_call>", "<|system|>",
)


def slugify(x: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one dash, no dash at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the fields joined by U+001F; null fields count as empty."""
    return F.sha2(F.concat_ws(UNIT, *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def compact(x: Column, most: int) -> Column:
    """White space runs as one space, cut to ``most`` characters with "..." at the end."""
    one = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most - 3)), F.lit("..."))).otherwise(one)


def search_terms(x: Column) -> Column:
    """Terms of a query: runs of letters, digits, _ and -, of more than one byte, in lower case."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}_-]+"), lambda t: F.octet_length(t) > 1)


def keyword_terms(x: Column) -> Column:
    """Like :func:`search_terms`, by more than one character."""
    return F.filter(F.split(F.lower(x), r"[^\p{L}\p{N}_-]+"), lambda t: F.length(t) > 1)


def ascii_tokens(x: Column) -> Column:
    """Runs of ASCII letters and digits in lower case."""
    return F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: t != "")


def scope_chain(path: Column) -> Column:
    """The scope and its ancestors, the root "" first: a/b gives "", a, a/b."""
    parts = F.split(path, "/")
    below = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.when(path == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), below))


def valid_scope(path: Column) -> Column:
    """Segments of [A-Za-z0-9._-] joined by single slashes, or the root."""
    return F.trim(path).rlike(r"^([A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*)?$")


def display_scope(path: Column) -> Column:
    return F.when(path == "", F.lit("global")).otherwise(path)


def capped(x: Column, most: int = 12_000) -> Column:
    """An event's text, cut to ``most`` characters with a marker."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("\n[truncated]"))).otherwise(x)


def entropy(x: Column) -> Column:
    """Shannon entropy of the characters, in bits each; 0 for the empty text."""
    # equal characters stand together once sorted: the sum over runs of n log n gives the entropy in one pass
    added = lambda a: a["total"] + a["n"] * F.log2(F.greatest(a["n"], F.lit(1.0)))
    state = lambda last, n, total: F.struct(last.alias("last"), n.alias("n"), total.alias("total"))
    step = lambda a, c: F.when(c == a["last"], state(c, a["n"] + 1, a["total"])).otherwise(state(c, F.lit(1.0), added(a)))
    total = F.aggregate(F.array_sort(F.split(x, "")), state(F.lit(""), F.lit(0.0), F.lit(0.0)), step, added)
    return F.when(F.length(x) > 0, F.log2(F.length(x)) - total / F.length(x)).otherwise(0.0)


def injection_signals(x: Column) -> Column:
    """The signals that the text holds, ASCII letters in any case, in the list's order."""
    signals = F.array(*[F.lit(s) for s in INJECTION_SIGNALS])
    # a text is lowered once, however many signals are looked up in it; no letter outside ASCII has one of the signals' (there is no k) as its lower case alone
    return F.transform(F.array(F.lower(x)), lambda low: F.filter(signals, lambda s: F.contains(low, s)))[0]


def relation_spec(x: Column) -> Column:
    """``target:relation`` as a struct, both trimmed; null unless both are there."""
    target, relation = F.trim(F.regexp_extract(x, "^([^:]*):", 1)), F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1))
    return F.when((target != "") & (relation != ""), F.struct(target.alias("target"), relation.alias("relation")))


def role(x: Column) -> Column:
    """Roles of transcripts folded to user, assistant, system or tool; anything else is as it is, in lower case."""
    low = F.lower(F.trim(x))
    return F.when(low.isin("human", "user"), "user").when(low.isin("ai", "assistant", "model", "agent"), "assistant").otherwise(low)
