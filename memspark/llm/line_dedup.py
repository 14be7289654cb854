"""Near-duplicate lines by a deletion-neighbourhood join, in native Spark operations only.

A line is a copy if an earlier line, by document id and line number, is equal to it or within one edit of it (one
character inserted, deleted or replaced). Two lines are within one edit exactly if deleting at most one character from each gives
the same text: replaced characters stand at the same place of two lines of one length, and a line with a character more
gives the shorter one when that is deleted. So lines emit their variants as hashed keys, with the place of the
deletion; lines that meet in a key are within one edit, and a key needs only its earliest line: no pairs are formed.

Most lines have no partner, and most variants can't meet another. What is left and right of an edit is equal in both
lines; so a line first emits one key for each half of the places where a character may go: the text outside
that half. Only where such a key is met by another line is the half cut into PARTS smaller windows, each with the key of
what is outside, and so on, until a window has WINDOW places at most. Variants are emitted for the places of
windows that are met to the end. A line of any length costs a few times its own length for each round, and rounds
follow the logarithm of the longest line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.llm.names import inner
from memspark.llm.store import stored

#: Places of a window whose variants are emitted, and windows that a larger one is cut into.
WINDOW, PARTS = 32, 16
#: Rows up to which a narrow table is broadcast, and line numbers up to which the copies' table is.
BROADCAST_ROWS, BROADCAST_NUMBERS = 400_000, 3_000_000
_SPACE = " \t\n\x0b\x0c\r"
_BY_LINE = ["_h", "_g"]


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _hashes(line: str) -> list[Column]:
    """Two independent hashes, which tell lines apart."""
    return [F.xxhash64(line).alias("_h"), F.xxhash64(F.lit(1), line).alias("_g")]


def _outside(m: str, a: str, b: str) -> str:
    """Key of a line ``t`` for variants of ``m`` characters that come of a deletion at places after ``a`` up to ``b``.

    A line of m + 1 characters loses one of them there; a line of m characters is what another became. What is left and right
    of the window is the same for both.
    """
    return f"xxhash64({m}, {a}, {b}, left(t, CAST({a} AS INT)), right(t, CAST({m} + 1 - {b} AS INT)))"


def _halves() -> list[Column]:
    """The keys of both halves, for the line that loses a character (0, 1) and for the line as it is (2, 3)."""
    middle = lambda m: f"(({m} + 1) DIV 2)"
    return [F.expr(_outside(m, a, b)).alias(f"_k{i}") for i, (m, a, b) in enumerate((m, *ab) for m in ("(n - 1)", "n") for ab in (("0L", middle(m)), (middle(m), f"({m} + 1L)")))]


def lines_of(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 1) -> DataFrame:
    """_id, _at (0, 1, ... within the text), t, n: the lines with a word, of ``least`` characters or more, of every row."""
    found = docs.select(docs[key].alias("_id"), F.posexplode(F.split(docs[text], "\n", -1)).alias("_at", "t"))
    found = found.where(F.ltrim(F.col("t"), F.lit(_SPACE)) != "").withColumn("n", F.length("t").cast("long"))
    return found.where(F.col("n") >= least)


def _met(windows: DataFrame) -> DataFrame:
    """The keys of ``windows`` (_h, _g, lost, k) that two lines have, one of them as a line that lost a character."""
    met = windows.groupBy("k").agg(F.min("_h").alias("_a"), F.max("_h").alias("_b"), F.min("_g").alias("_c"), F.max("_g").alias("_d"), F.max("lost").alias("_lost"))
    return met.where("_lost AND (_a < _b OR _c < _d)").select("k")


def _near(first: DataFrame, docs: DataFrame, text: str, key: str) -> DataFrame:
    """_h, _g of the lines of ``first`` (_h, _g, o, n, _k0.._k3) that are one edit from an earlier one."""
    keys = F.posexplode(F.array("_k0", "_k1", "_k2", "_k3")).alias("j", "k")
    half = first.select(*_BY_LINE, keys).withColumn("lost", F.col("j") < 2)
    met = _small(stored(_met(half), "met"))
    m = F.col("n") - F.col("lost").cast("long")
    middle = F.floor((m + 1) / 2)
    lower = F.col("j") % 2 == 0
    bounds = {"m": m, "lo": F.when(lower, 0).otherwise(middle), "hi": F.when(lower, middle).otherwise(m + 1)}
    windows = first.select(*_BY_LINE, "o", "n", keys).withColumn("lost", F.col("j") < 2).join(met, "k", "left_semi")
    windows = stored(windows.withColumns(bounds).where("lo < hi").select(*_BY_LINE, "o", "lost", "m", "lo", "hi"), "windows")

    # the texts of these lines, from the documents that have them first
    places = windows.select(F.col("o.id").alias("_ld_id"), F.col("o.at").alias("_ld_at")).groupBy("_ld_id").agg(F.collect_set("_ld_at").alias("_ld_places"))
    some = docs.select(docs[key].alias("_ld_key"), docs[text].alias("_ld_text")).join(_small(stored(places, "places")), F.col("_ld_key").eqNullSafe(F.col("_ld_id")))
    lines = some.select("_ld_places", F.posexplode(F.split("_ld_text", "\n", -1)).alias("_at", "t")).where(F.array_contains("_ld_places", F.col("_at")))
    wanted = stored(windows.select(*_BY_LINE).distinct(), "wanted")
    lines = lines.select(*_hashes("t"), "t").join(_small(wanted), _BY_LINE, "left_semi").dropDuplicates(_BY_LINE)
    lines = stored(lines, "texts")

    while (windows.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0) > WINDOW:
        large = F.col("hi") - F.col("lo") > WINDOW
        cut = f"transform(sequence(0, {PARTS} - 1), s -> named_struct('a', lo + (hi - lo) * s DIV {PARTS}, 'b', lo + (hi - lo) * (s + 1) DIV {PARTS}))"
        cut = F.expr(f"transform({cut}, w -> named_struct('lo', w.a, 'hi', w.b, 'k', {_outside('m', 'w.a', 'w.b')}))")
        parts = windows.where(large).join(lines, _BY_LINE).select(*_BY_LINE, "o", "lost", "m", F.explode(cut).alias("w"))
        parts = stored(parts.select(*_BY_LINE, "o", "lost", "m", "w.*").where("lo < hi"), "parts")
        parts = parts.join(_small(stored(_met(parts), "met")), "k", "left_semi").drop("k")
        windows = stored(windows.where(~large).unionByName(parts), "windows")

    # the variants: what a line is without the i-th character, with and without the place; and the line as it is
    without = "xxhash64(x.m, x.f, concat(left(x.w, i - 1), substring(x.w, i + 1)), x.l, x.lo)"
    same = "xxhash64(m, xxhash64(left(t, CAST(lo AS INT))), substring(t, CAST(lo + 1 AS INT), CAST(hi - lo - 1 AS INT)), xxhash64(right(t, CAST(m + 1 - hi AS INT))), lo)"
    window = "array(named_struct('m', m, 'lo', lo, 'f', xxhash64(left(t, CAST(lo AS INT))), 'w', substring(t, CAST(lo + 1 AS INT), CAST(hi - lo AS INT)), 'l', xxhash64(right(t, CAST(m + 1 - hi AS INT)))))"
    lost = f"flatten(flatten(transform({window}, x -> transform(sequence(1, CAST(hi - lo AS INT)), i -> array(named_struct('k', {without}, 'own', false), named_struct('k', xxhash64({without}, i), 'own', CAST(null AS BOOLEAN)))))))"
    variants = F.expr(f"CASE WHEN lost THEN {lost} ELSE array(named_struct('k', {same}, 'own', true)) END")
    keys = windows.join(lines, _BY_LINE).select("o", F.explode(variants).alias("v")).select("o", "v.k", "v.own")
    keys = stored(keys, "variants")
    # the earliest line of a key, among those that are the text itself, that lost a character, or that lost one at the same place
    tops = keys.groupBy("k", "own").agg(F.min("o").alias("_first"), F.count("*").alias("_n"))
    tops = tops.groupBy("k").agg(
        F.min(F.when(F.col("own"), F.col("_first"))).alias("_own"), F.min(F.when(~F.col("own"), F.col("_first"))).alias("_lost"),
        F.min(F.when(F.col("own").isNull(), F.col("_first"))).alias("_same"), F.sum("_n").alias("_n"),
    )
    tops = _small(stored(tops.where("_n > 1 AND (_same IS NOT NULL OR _own IS NOT NULL AND _lost IS NOT NULL)"), "tops"))
    near = keys.join(tops, "k")
    near = near.withColumn("_by", F.when(F.col("own"), F.col("_lost")).when(~F.col("own"), F.col("_own")).otherwise(F.col("_same")))
    near = stored(near.where(F.col("_by") < F.col("o")).groupBy("o").agg(F.min("_by").alias("_by")), "near")
    # hashes may meet by chance: the texts decide
    texts = windows.select("o", *_BY_LINE).distinct().join(lines, _BY_LINE)
    near = near.join(texts, "o").join(texts.select(F.col("o").alias("_by"), F.col("t").alias("_u")), "_by")
    return near.where(F.levenshtein("t", "_u", 1).between(0, 1)).select(*_BY_LINE)


def copies(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 1) -> DataFrame:
    """_id, _at of every line that is a copy of an earlier one."""
    found = lines_of(docs, text, key, least)
    found = stored(found.select("_id", "_at", "n", *_hashes("t"), *_halves()), "lines")
    order = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("id"), F.col("_at").alias("at"))
    halves = [F.min(f"_k{i}").alias(f"_k{i}") for i in range(4)]
    first = stored(found.groupBy(*_BY_LINE).agg(F.min(order).alias("o"), F.count("*").alias("_n"), F.min("n").alias("n"), *halves), "first")
    # equal lines: all but the earliest; lines near an earlier one: all
    near = stored(_near(first, docs, text, key), "gone").distinct().withColumn("_near", F.lit(True))
    marked = first.where("_n > 1").select(*_BY_LINE, "o").join(near, _BY_LINE, "full")
    marked = _small(stored(marked, "marked"))
    return found.select("_id", "_at", *_BY_LINE).join(marked, _BY_LINE).where(F.col("_near") | ~order.eqNullSafe(F.col("o"))).select("_id", "_at")


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 1, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with copied lines cut from ``text``, and its lines and those removed in the columns ``counts``.

    Lines are what "\\n" splits. Lines without a word stay, and so do lines of under ``least`` characters. A null text
    stays null with 0 lines; an empty one has one empty line. Rows without id come after all others. Rows of one id share
    their line numbers: an equal line at an equal place of them counts as the same line, and stays. An empty table gives none.
    """
    of, places = inner(docs, "of", "gone")
    n_lines, n_removed = counts
    gone = copies(docs, text, key, least).withColumnRenamed("_id", of).groupBy(of).agg(F.collect_set("_at").alias(places))
    gone = stored(gone, "copies")
    few = (gone.agg(F.sum(F.size(places) + 2)).first()[0] or 0) <= BROADCAST_NUMBERS
    names = [c for c in docs.columns if c not in counts]
    out = docs.select(*names).join(F.broadcast(gone) if few else gone, F.col(key).eqNullSafe(F.col(of)), "left").drop(of)
    out = out.withColumn(n_lines, F.coalesce(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long"))
    lines = F.array(F.split(text, "\n", -1))
    kept = F.transform(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), places), lambda i: x[i]), "\n"))[0]
    out = out.withColumn(text, F.when(F.col(places).isNull(), F.col(text)).otherwise(kept))
    return out.withColumn(n_removed, F.coalesce(F.size(places), F.lit(0)).cast("long")).select(*names, *counts)
