"""Mixing sources to target weights by pivotal dependent rounding, in native Spark operations only.

A source's target over its size is the number of copies that each of its documents should have on average. The whole
part of it is certain; the fractional part is a probability that rounding turns into 0 or 1. Pivotal rounding takes two
documents of a source and moves probability mass between them, counted in words, one way or the other at random, until
one of them is settled: the expected copies of each stay as they are, and so do the words of the two together. A leaf
holds a bounded number of documents of about equal length and settles all but one; those that remain meet in the next
level of a reduction tree, until a source has one for each order of length at most. These last few, of very different
lengths, are rounded from the longest to the shortest so that the words come nearest the target.

The random numbers are hashes of the document ids, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.store import stored

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at this many times its source's size.
MOST_COPIES = 3
#: Ratios that are sorted at the end of the search for the level, and steps of a round before.
LAST, STEPS = 10_000, 32
#: Documents that a node of the reduction tree takes, on average.
NODE = 48
#: The table of sources is broadcast up to this many rows; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 20_000
_WORD = r"[\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    """Words of ``text``, runs of characters other than 0x20 and 0x09 to 0x0D; a null text has none."""
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(plain, " +"), lambda w: w != "")).cast("long")


def _weighted(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``sizes`` with the weight of each source in _w, by its place in code point order, nulls last.

    Sources are dealt out by ranges and sorted within them; a source's place is its number there and the rows before.
    """
    ordered = sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ordered = ordered.withColumn("_id", F.monotonically_increasing_id())
    ordered = stored(ordered.select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND((1 << 33) - 1).alias("_nth")).drop("_id"), "ordered")
    parts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ordered.join(F.broadcast(parts.select("_part", before.alias("_before"))), "_part")  # as many rows as ranges
    place = (F.col("_before") + F.col("_nth")) % len(weights)
    return placed.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("_w"))


def _level(sources: DataFrame) -> float:
    """The level c at which min(_stop, c * _w) of ``sources`` add up to the sum of their sizes.

    Sources stop in order of _ratio = _stop / _w. Rounds of aggregates narrow down the ratios between which c lies, until at
    most LAST of them are left, which are sorted.
    """
    lo, hi = float("-inf"), float("inf")
    while True:
        inside = sources.where((F.col("_ratio") > lo) & (F.col("_ratio") < hi))
        below, above = F.col("_ratio") <= lo, F.col("_ratio") >= hi
        of = lambda where, x: F.coalesce(F.sum(F.when(where, F.col(x))), F.lit(0))
        total, stopped, free, n = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), of(below, "_stop"), of(above, "_w"), F.count(F.when(~below & ~above, True))
        ).first()
        if n <= LAST:
            rows = sorted((r["_ratio"], r["_stop"], r["_w"]) for r in inside.select("_ratio", "_stop", "_w").collect())
            free += sum(w for *_, w in rows)
            for ratio, stop, w in rows:
                if free and (total - stopped) / free <= ratio:
                    break
                stopped, free = stopped + stop, free - w
            return (total - stopped) / free if free else hi
        steps = sorted(set(inside.approxQuantile("_ratio", [k / STEPS for k in range(1, STEPS)], 0.001)))
        reach = lambda c: of(F.col("_ratio") < c, "_stop") + c * of(F.col("_ratio") >= c, "_w")
        words = sources.agg(*[reach(c).alias(f"c{i}") for i, c in enumerate(steps)]).first()
        lo = max([lo, *(c for c, x in zip(steps, words, strict=True) if x < total)])
        hi = min([hi, *(c for c, x in zip(steps, words, strict=True) if x >= total)])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source``, source_size, target from ``source``, ``source_size``: one row for each source.

    Shares follow the weights; a target above ``most`` times its size stops there, and the excess goes to the others by
    weight until none is above. That is the level c at which the targets min(most * size, c * weight) add up to all words.
    """
    stop = (F.lit(most) * F.col("source_size")).alias("_stop")
    sources = stored(_weighted(sizes, weights).select("*", stop, (F.lit(most) * F.col("source_size") / F.col("_w")).alias("_ratio")), "sources")
    level = _level(sources)
    target = F.least(F.col("_stop").cast("double"), F.lit(level) * F.col("_w"))
    return sources.select("source", "source_size", target.alias("target"))


def _settle(items: str) -> Column:
    """Pivotal rounding of an array of structs (k, id, nth, s, p, u): the settled ones, and the one that stays open or null.

    u is a uniform random number; a step moves words between the open document a and the next one b.
    """
    up = "least((1 - a.p) * a.s, b.p * b.s)"  # words from b to a
    down = "least(a.p * a.s, (1 - b.p) * b.s)"  # words from a to b
    moved = f"IF(b.u * ({up} + {down}) < {down}, {up}, -{down})"

    def settled(x: str) -> str:
        return f"({x}.p < 1e-9 OR {x}.p > 1 - 1e-9)"

    one = "named_struct('k', {0}.k, 'id', {0}.id, 'nth', {0}.nth, 's', {0}.s, 'p', {1}, 'u', {0}.u)"
    pair = f"transform(array({moved}), m -> named_struct('a', {one.format('a', 'a.p + m / a.s')}, 'b', {one.format('b', 'b.p - m / b.s')}))[0]"
    split = (
        "named_struct("
        f"'open', CASE WHEN NOT {settled('q.a')} THEN q.a WHEN NOT {settled('q.b')} THEN q.b END, "
        f"'done', concat(acc.done, IF({settled('q.a')}, array(q.a), slice(array(q.a), 1, 0)), IF({settled('q.b')}, array(q.b), slice(array(q.b), 1, 0))))"
    )
    step = f"IF(acc.open IS NULL, named_struct('open', b, 'done', acc.done), transform(array(acc.open), a -> transform(array({pair}), q -> {split})[0])[0])"
    return F.expr(f"aggregate({items}, named_struct('open', IF(false, {items}[0], null), 'done', slice({items}, 1, 0)), (acc, b) -> {step})")


def _last(items: str) -> Column:
    """Rounds an array of structs (s, p, ...) in descending order of s: p becomes 1 where that brings the words nearest to the sum of p * s."""
    words = f"aggregate({items}, 0D, (t, x) -> t + x.p * x.s)"
    rest = f"aggregate({items}, 0D, (t, x) -> t + x.s)"
    one = "named_struct('k', x.k, 'id', x.id, 'nth', x.nth, 's', x.s, 'p', IF({take}, 1D, 0D), 'u', x.u)"
    # without x, the later ones reach acc.rest - x.s at most; with it, what is above acc.words stays above
    take = "acc.words - x.s >= 0 OR abs(acc.words - x.s) < acc.words - least(acc.words, acc.rest - x.s)"
    step = (
        f"named_struct('words', IF({take}, acc.words - x.s, acc.words), 'rest', acc.rest - x.s, "
        f"'done', concat(acc.done, array({one.format(take=take)})))"
    )
    return F.expr(f"aggregate({items}, named_struct('words', {words}, 'rest', {rest}, 'done', slice({items}, 1, 0)), (acc, x) -> {step}, acc -> acc.done)")


def mix_sources(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``key``, source, size, source_size, target, copies and taken of every row of ``docs``.

    A null source is a source of its own, after all others; a null text has size 0. Documents of size 0 are taken 0
    times. Repeated rows of one id are rounded one by one; which of them gets a copy more is open, as they agree in id
    and size. An empty table gives none.
    """
    rows = docs.select(docs[key].alias("_id"), docs[source].alias("source"), n_words(text).alias("size"))
    # rows that agree in id and size are told apart by a number
    nth = Window.partitionBy("_id", "source", "size").orderBy(F.lit(1))
    rows = stored(rows.withColumn("_nth", F.row_number().over(nth)), "sizes")
    per_source = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "targets")
    few = per_source.count() <= BROADCAST_ROWS
    right = per_source.withColumnRenamed("source", "_source")
    rows = rows.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST_COPIES)))).otherwise(0.0)
    rows = rows.withColumn("_ratio", F.when(F.abs(ratio - F.round(ratio)) < 1e-9, F.round(ratio)).otherwise(ratio))
    rows = rows.withColumn("_whole", F.floor("_ratio")).withColumn("_p", F.col("_ratio") - F.floor("_ratio"))
    rounded = _rounded(rows.where("_p > 0 AND size > 0"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("_id", "source", "size", "_nth")]
    rows = rows.alias("l").join(rounded.alias("r"), same, "left")
    copies = F.when(F.col("l.size") > 0, F.col("_whole") + F.coalesce("_more", F.lit(0))).otherwise(0).cast("long")
    return rows.select(
        F.col("l._id").alias(key), F.col("l.source").alias("source"), F.col("l.size").alias("size"), "source_size", "target",
        copies.alias("copies"), (copies * F.col("l.size")).alias("taken"),
    )


def _rounded(rows: DataFrame) -> DataFrame:
    """_id, source, size, _nth, _more (0 or 1) of every row, by the reduction tree."""
    order = F.floor(F.log2("size")).cast("int")
    item = F.struct(
        F.xxhash64("_id", "size", "_nth").alias("k"), F.col("_id").alias("id"), F.col("_nth").alias("nth"), F.col("size").cast("double").alias("s"), F.col("_p").alias("p"), F.lit(0.0).alias("u")
    )
    left = rows.select("source", order.alias("_order"), item.alias("x"))
    done, level = None, 0
    while True:
        counts = left.groupBy("source", "_order").agg(F.count("*").alias("_n"))
        most = counts.agg(F.max("_n")).first()[0] or 0
        if most <= 1:
            break
        # nodes of NODE documents on average; a node is a random part of its source and order of length
        nodes = F.broadcast(stored(counts, f"counts{level}")) if counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else counts
        here = left.alias("l").join(nodes.alias("c"), F.col("l.source").eqNullSafe(F.col("c.source")) & (F.col("l._order") == F.col("c._order")))
        node = F.pmod(F.xxhash64(F.col("x.k"), F.lit(level)), F.ceil(F.col("c._n") / NODE))
        drawn = F.transform(F.array("x"), lambda x: x.withField("u", (F.pmod(F.xxhash64(x["k"], x["id"], F.lit(level + 1000)), F.lit(1 << 53)) / float(1 << 53))))[0]
        here = here.select(F.col("l.source").alias("source"), F.col("l._order").alias("_order"), node.alias("_node"), drawn.alias("x"))
        items = here.groupBy("source", "_order", "_node").agg(F.sort_array(F.collect_list("x")).alias("_items"))
        out = stored(items.withColumn("_r", _settle("_items")).select("source", "_order", "_r.open", "_r.done"), f"level{level}")
        settled = out.select("source", F.explode("done").alias("x"))
        done = settled if done is None else done.unionByName(settled)
        left = out.where("open IS NOT NULL").select("source", "_order", F.col("open").alias("x"))
        level += 1
    last = left.groupBy("source").agg(F.sort_array(F.collect_list(F.struct(F.col("x.s").alias("s"), "x")), False).alias("_s"))
    last = last.withColumn("_items", F.col("_s.x")).select("source", F.explode(_last("_items")).alias("x"))
    done = last if done is None else done.unionByName(last)
    return done.select(F.col("x.id").alias("_id"), "source", F.col("x.s").cast("long").alias("size"), F.col("x.nth").alias("_nth"), F.round("x.p").cast("long").alias("_more"))
