"""Secrets in texts, with credentials that are spread over several parts, in native Spark operations only.

Strong spans speak for themselves: assignments of 12 characters or more to a telling name, access identifiers, long
hexadecimal runs. Weak candidates (names of accounts, short or unnamed secrets, endpoints) are common in clean text. They are
parts of a credential only together: a weak secret beside an identifier or an endpoint, an identifier or an endpoint
beside a secret. So candidates are linked by an interval join: two parts are in one scope if at most SCOPE code points lie
between them. The text is laid in cells of SCOPE code points; of each cell only the first and the last place of either
role is kept, which is enough to tell whether a partner is within reach, so no pairs are formed and a page full of parts
costs its length.

Matches of a pattern don't overlap, so what lies between them and their lengths give their places: one split, one
extraction, and a running sum over blocks of BLOCK matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.names import inner
from memspark.llm.store import stored

#: Code points between two parts of a credential, at most.
SCOPE = 200
#: Matches whose places are summed up in one go.
BLOCK = 256
#: Spans that are broadcast at most.
BROADCAST_SPANS = 200_000
_TO = r"""["']?\x20*[:=]\x20*["']?"""
#: The strong kinds, in their order: pattern, the group that is measured and its least length. These are fixed values, but for what
#: stands before a pattern: its first character, so that most places are passed by.
STRONG = (
    ("assign", rf"(?=[PpSsTtAa])((?i:password|passwd|secret|token|api_?key)){_TO}([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: The weak kinds, after the strong ones: pattern and what a match must hold besides.
WEAK = (
    ("identifier", rf"(?=[UuLlAaCc])(?:(?i:user_?name|user|login|account|client_?id|access_?key_?id|access_?key){_TO}[A-Za-z0-9_.@+-]{{3,}}|AKIA[A-Z0-9]{{4,}})", None),
    ("secret", rf"(?=[PpSsTtAaCc])(?i:password|passwd|passphrase|pwd|secret|token|api_?key|credential){_TO}[A-Za-z0-9+/_.=!@#$%^&*-]{{6,}}|(?<![A-Za-z0-9+_-])[A-Za-z0-9+_-]{{20,}}", r"[:=]|[0-9][^0-9]*[A-Za-z]|[A-Za-z][^A-Za-z]*[0-9]"),
    ("endpoint", rf"(?=[HhFfSsPpMmRrAaEe])(?:(?:https?|ftps?|ssh|s3|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s\"'<>]{{3,}}|(?i:host|hostname|server|endpoint){_TO}[A-Za-z0-9.-]{{4,}})", None),
)
KINDS = tuple(k[0] for k in STRONG + WEAK)
_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _placed(found: Column, gaps: Column, kind: int) -> Column:
    """start, kind, end of every match: ``gaps`` has what lies before each of ``found``, and after the last."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def match(state: Column, i: Column) -> Column:
        at = state["at"] + F.length(F.get(gaps, i))
        end = at + F.length(F.get(found, i))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))).alias("out"))

    def block(state: Column, first: Column) -> Column:
        last = F.least(first + BLOCK, F.size(found)) - 1
        empty = F.struct(state["at"].alias("at"), F.array().cast(_SPAN).alias("out"))
        done = F.aggregate(F.sequence(first, last), empty, match)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(state["out"], d["out"]).alias("out")))[0]

    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1, F.lit(BLOCK)), start, block)["out"]


def _matches(text: Column, pattern: str, kind: int, group: int, wanted) -> Column:
    """The spans of ``pattern`` in ``text`` whose ``group`` is ``wanted``."""
    all_, rx = (lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))), F.lit(pattern)
    parts = F.array(F.struct(all_(0).alias("found"), F.split(text, pattern, -1).alias("gaps"), all_(group).alias("value")))
    spans = F.transform(parts, lambda x: F.filter(_placed(x["found"], x["gaps"], kind), lambda _, i: wanted(F.get(x["value"], i))))[0]
    return F.when(F.rlike(text, rx), spans).otherwise(F.array().cast(_SPAN))


def _strong(text: Column, kind: int) -> Column:
    _, pattern, group, least = STRONG[kind]
    return _matches(text, pattern, kind, group, lambda v: F.length(v) >= least)


def _weak(text: Column, kind: int) -> Column:
    _, pattern, holds = WEAK[kind]
    return _matches(text, pattern, len(STRONG) + kind, 0, lambda v: F.rlike(v, F.lit(holds)) if holds else F.lit(True))


def _line(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _apart(parts: DataFrame) -> DataFrame:
    """``parts`` without weak ones that overlap a strong one of their text: the last end before them and the first start after them tell."""
    strong = F.col("kind") < len(STRONG)
    order = Window.partitionBy("text_key").orderBy("start", "kind", "end")
    ends = F.max(F.when(strong, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.min(F.when(strong, F.col("start"))).over(Window.partitionBy("text_key").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    marked = parts.withColumns({"_ends": ends, "_begins": begins})
    return marked.where(strong | ((F.coalesce("_ends", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("_begins") >= F.col("end"), F.lit(True)))).drop("_ends", "_begins")


def linked(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak rows of ``parts`` (text_key, start, kind, end) that have a complementary part within ``scope`` code points.

    Parts that overlap are no partners, and a weak part that overlaps a strong one is none itself: the strong span has it.
    """
    secret = F.col("kind").isin(0, 2, 4)
    parts = parts.withColumns({"secret": secret, "weak": F.col("kind") >= len(STRONG)})
    cell = lambda c: F.floor(c / scope)
    # the last end before a part, the first start after it: the outermost of a cell tell
    sides = F.explode(F.array(F.struct(F.lit(True).alias("before"), F.col("end").alias("at")), F.struct(F.lit(False).alias("before"), F.col("start").alias("at")))).alias("x")
    anchors = parts.select("text_key", "secret", sides).select("text_key", "secret", "x.*").groupBy("text_key", "secret", "before", cell(F.col("at")).alias("cell"))
    anchors = anchors.agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    look = [(True, cell(F.col("start")) - i) for i in (0, 1)] + [(False, cell(F.col("end")) + i) for i in (0, 1)]
    asks = parts.where("weak").select("text_key", "start", "kind", "end", (~F.col("secret")).alias("secret"), F.explode(F.array(*(F.struct(F.lit(b).alias("before"), c.alias("cell")) for b, c in look))).alias("x"))
    asks = asks.select("text_key", "start", "kind", "end", "secret", "x.*").join(anchors, ["text_key", "secret", "before", "cell"])
    same = F.col("cell") == F.when(F.col("before"), cell(F.col("start"))).otherwise(cell(F.col("end")))
    before = F.when(same, F.col("lo") <= F.col("start")).otherwise(F.col("hi") >= F.col("start") - scope)
    after = F.when(same, F.col("hi") >= F.col("end")).otherwise(F.col("lo") <= F.col("end") + scope)
    return asks.where(F.when(F.col("before"), before).otherwise(after)).select("text_key", "start", "kind", "end").distinct()


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), scope: int = SCOPE) -> DataFrame:
    """The ``keep`` columns of every row of ``docs``, n_assign, n_access, n_hex, base (the strong spans) and spans (all).

    Spans are arrays of (start, kind, end), ordered; kind counts KINDS from 0, places are code points, ends exclusive. A null
    text counts as empty; a text without spans has empty arrays; repeated rows repeat; an empty table gives none. Only ``keep`` and
    ``text`` are read, so other columns may have any name.
    """
    t, base, weak, key, of, spans = inner(docs.select(*keep), "text", "base", "weak", "key", "of", "spans")
    found = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(t))
    found = found.withColumns({base: F.array_sort(F.concat(*(_strong(F.col(t), k) for k in range(len(STRONG))))), weak: _weak(F.col(t), 1)})
    # without a secret there is nothing that an identifier or an endpoint could belong to
    alone = ~F.exists(F.concat(base, weak), lambda s: s["kind"].isin(0, 2, 4))
    found = found.withColumn(weak, F.when(alone, F.col(weak)).otherwise(F.concat(weak, _weak(F.col(t), 0), _weak(F.col(t), 2))))
    every = F.concat(base, weak)
    holds = lambda *kinds: F.exists(every, lambda s: s["kind"].isin(*kinds))
    # what the scopes decide depends on the text alone, so copies of a text ask once
    found = found.withColumn(key, F.when((F.size(weak) > 0) & holds(0, 2, 4) & holds(1, 3, 5), F.sha2(t, 256))).drop(t)
    found = stored(found, "secret_spans")
    some = found.where(F.col(key).isNotNull())
    names = ("start", "kind", "end")
    parts = some.select(F.col(key).alias("text_key"), F.explode(every).alias("s")).select("text_key", *(F.col(f"s.{c}") for c in names)).distinct()
    hits = stored(linked(_apart(parts), scope), "secret_links")
    added = hits.groupBy(F.col("text_key").alias(of)).agg(F.collect_list(F.struct(*names)).alias(spans))
    few = hits.limit(BROADCAST_SPANS + 1).count() <= BROADCAST_SPANS
    with_links = some.join(F.broadcast(added) if few else added, F.col(key) == F.col(of), "left").drop(of)
    out = found.where(F.col(key).isNull()).withColumn(spans, F.array().cast(_SPAN)).unionByName(with_links)
    out = out.withColumn(spans, F.array_sort(F.concat(base, F.coalesce(spans, F.array().cast(_SPAN)))))
    of_kind = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{name}") for k, (name, *_) in enumerate(STRONG)]
    return out.select(*keep, *counts, F.col(base).alias("base"), F.col(spans).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """``found`` (of ``scan``) with base_sha256 and spans as one line in place of the arrays."""
    return found.withColumns({"base_sha256": F.sha2(_line(F.col("base")), 256), "spans": _line(F.col("spans"))}).drop("base")
