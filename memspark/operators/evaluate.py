"""Retrieval metrics, resampling statistics and gates over tables of runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CUTS = {"ndcg": (1, 3, 5, 10), "recall": (5, 10, 20), "precision": (5, 10), "success": (1, 5)}
_GAMMA = 0x9E3779B97F4A7C15


def metrics(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """A row for each qid of ``qrels`` (qid, id, grade): nDCG, recall, precision, success, MRR, MAP and judged@10 of ``run`` (qid, id, rank from 1).

    Queries without results score 0. Gains are linear; a precision's denominator is its cut.
    """
    discount = 1 / F.log2(F.col("rank") + 1)
    ranked = run.join(qrels, ["qid", "id"], "left").withColumn("_rel", (F.coalesce("grade", F.lit(0)) > 0).cast("int"))
    w = Window.partitionBy("qid").orderBy("rank")
    ranked = ranked.withColumn("_hits", F.sum("_rel").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    within = lambda k, x: F.sum(F.when(F.col("rank") <= k, x).otherwise(0))
    aggs = [within(k, F.coalesce("grade", F.lit(0)) * discount).alias(f"_dcg{k}") for k in CUTS["ndcg"]]
    aggs += [within(k, F.col("_rel")).alias(f"_rel{k}") for k in (1, 5, 10, 20)]
    aggs += [F.min(F.when(F.col("_rel") == 1, F.col("rank"))).alias("_first"), F.sum(F.col("_rel") * F.col("_hits") / F.col("rank")).alias("_ap")]
    aggs += [within(10, F.col("grade").isNotNull().cast("int")).alias("_judged"), F.least(F.max("rank"), F.lit(10)).alias("_ten")]
    got = ranked.groupBy("qid").agg(*aggs)
    best = qrels.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), "id")))
    ideal = best.groupBy("qid").agg(*[within(k, F.col("grade") * discount).alias(f"_idcg{k}") for k in CUTS["ndcg"]], F.sum((F.col("grade") > 0).cast("int")).alias("_all"))
    both = ideal.join(got, "qid", "left").na.fill(0)
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    out = [ratio(f"_dcg{k}", f"_idcg{k}").alias(f"ndcg_{k}") for k in CUTS["ndcg"]]
    out += [ratio(f"_rel{k}", "_all").alias(f"recall_{k}") for k in CUTS["recall"]]
    out += [F.round(F.col(f"_rel{k}") / k, 6).alias(f"precision_{k}") for k in CUTS["precision"]]
    out += [(F.col(f"_rel{k}") > 0).cast("double").alias(f"success_{k}") for k in CUTS["success"]]
    out += [F.round(F.when(F.col("_first") > 0, 1 / F.col("_first")).otherwise(0.0), 6).alias("mrr"), ratio("_ap", "_all").alias("map"), ratio("_judged", "_ten").alias("judged_10")]
    return both.select("qid", *out)


def macro(per_query: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """metric, value (and the columns ``by``, such as a record type): averages over all queries, to six places; half a unit rounds up. Values count in whole millionths, so sums are exact."""
    names = [c for c in per_query.columns if c != "qid" and c not in by]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in names])).alias("p")
    sums = per_query.select(*by, pairs).groupBy(*by, "p.metric").agg(F.sum(F.round(F.col("p.x") * 1_000_000).cast("long")).alias("_s"), F.count("p.x").alias("_n"))
    return sums.select(*by, "metric", (F.expr("(2 * _s + _n) DIV (2 * _n)") / 1_000_000).alias("value"))


def confusion(pairs: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1 of ``pairs`` (expected, found: booleans) for each group."""
    count = lambda e, f: F.sum(((F.col("expected") == e) & (F.col("found") == f)).cast("long"))
    out = pairs.groupBy(*by).agg(count(True, True).alias("tp"), count(False, True).alias("fp"), count(True, False).alias("fn"), count(False, False).alias("tn"))
    part = lambda *of: F.when(sum(map(F.col, of), F.lit(0)) > 0, F.col("tp") / sum(map(F.col, of), F.lit(0))).otherwise(0.0)
    out = out.withColumn("precision", F.round(part("tp", "fp"), 6)).withColumn("recall", F.round(part("tp", "fn"), 6))
    return out.withColumn("f1", F.round(F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0), 6))


def holm(tests: DataFrame) -> DataFrame:
    """name, p, adjusted: Holm's step-down correction over ``tests`` (name, p) within each ``family``."""
    w = Window.partitionBy("family").orderBy("p", "name")
    m = F.count("*").over(Window.partitionBy("family"))
    step = tests.withColumn("_a", F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col("p")))
    return step.select("family", "name", "p", F.round(F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)), 9).alias("adjusted"))


def gate(found: DataFrame, floors: DataFrame) -> DataFrame:
    """Failures of ``floors`` (metric, floor): metrics that are missing or below."""
    return floors.join(found, "metric", "left").where(F.col("value").isNull() | (F.col("value") < F.col("floor"))).select("metric", "floor", "value")


def _draws(n: np.ndarray, seed: int) -> np.ndarray:
    """The ``n``-th outputs of SplitMix64, which is counter based: any of them alone."""
    x = np.uint64(seed) + n.astype(np.uint64) * np.uint64(_GAMMA)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap(values: DataFrame, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """name, mean, low, high, se of each ``name``'s values (name, qid, x): a 95 % interval of the mean.

    A name's values are the metric of its queries, in order of qid; resamples of all names run in parallel.
    """
    lists = values.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("qid", "x"))).alias("v")).select("name", F.col("v.x").alias("v"))
    parts = lists.select("name", "v", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(100))).alias("lo")).repartition("name", "lo")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for pdf in batches:
                for name, v, lo in zip(pdf["name"], pdf["v"], pdf["lo"], strict=True):
                    v = np.asarray(v, float)
                    b = np.arange(lo, min(lo + 100, resamples))
                    picks = _draws(b[:, None] * len(v) + np.arange(len(v)) + 1, seed) % np.uint64(len(v))
                    yield pd.DataFrame({"name": name, "m": v[picks.astype(np.int64)].mean(axis=1)})

    means = parts.mapInPandas(run, "name string, m double").groupBy("name").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"), F.stddev_samp("m").alias("se"))
    return values.groupBy("name").agg(F.avg("x").alias("mean")).join(means, "name")


def paired(values: DataFrame, resamples: int = 2000, permutations: int = 10_000, seed: int = 42) -> DataFrame:
    """name, delta, p, low, high of ``values`` (name, qid, a, b): the mean of a - b, its permutation p and its bootstrap interval.

    The signs of the deltas are drawn anew in each permutation; p = (hits + 1) / (permutations + 1), a hit having a mean at
    least as large as the observed one. A name's deltas are its queries' in order of qid; blocks of permutations run in parallel.
    """
    deltas = values.select("name", "qid", (F.col("a") - F.col("b")).alias("x"))
    lists = deltas.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("qid", "x"))).alias("v")).select("name", F.col("v.x").alias("v"))
    parts = lists.select("name", "v", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1), F.lit(500))).alias("lo")).repartition("name", "lo")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for pdf in batches:
                for name, v, lo in zip(pdf["name"], pdf["v"], pdf["lo"], strict=True):
                    v = np.asarray(v, float)
                    b = np.arange(lo, min(lo + 500, permutations))
                    flip = (_draws(b[:, None] * len(v) + np.arange(len(v)) + 1, seed) & np.uint64(1)).astype(bool)
                    means = np.abs(np.where(flip, -v, v).mean(axis=1))
                    yield pd.DataFrame({"name": [name], "hits": [int((means >= abs(v.mean()) - 1e-12).sum())]})

    hits = parts.mapInPandas(run, "name string, hits long").groupBy("name").agg(((F.sum("hits") + 1) / (permutations + 1)).alias("p"))
    interval = bootstrap(deltas, resamples, seed)
    return interval.join(hits, "name").select("name", F.col("mean").alias("delta"), "p", "low", "high")


def compare_modes(per_query: DataFrame, base: str = "hybrid", **how) -> DataFrame:
    """mode, delta, p, p_holm, low, high: ``base`` against every other mode of ``per_query`` (mode, qid, x), over the queries that both have."""
    left = per_query.where(F.col("mode") == base).select("qid", F.col("x").alias("a"))
    pairs = per_query.where(F.col("mode") != base).join(left, "qid").select(F.col("mode").alias("name"), "qid", "a", F.col("x").alias("b"))
    found = paired(pairs, **how)
    adjusted = holm(found.select(F.lit("modes").alias("family"), "name", "p")).select("name", F.col("adjusted").alias("p_holm"))
    return found.join(adjusted, "name").select(F.col("name").alias("mode"), "delta", "p", "p_holm", "low", "high")


def lift(before: DataFrame, after: DataFrame, qrels: DataFrame) -> DataFrame:
    """metric, before, after, lift: macro averages of two runs (qid, id, rank) against the same judgements."""
    one = lambda run, name: macro(metrics(run, qrels)).withColumnRenamed("value", name)
    return one(before, "before").join(one(after, "after"), "metric").withColumn("lift", F.round(F.col("after") - F.col("before"), 6))
