"""Searches whose arms are found once, vectors added up in batches, and documents that stay where they are."""

import os

import pytest
from pyspark.sql import functions as F

from memspark.operators import search
from memspark.plans import assist
from memspark.queries import work

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_arms_found_once(spark, monkeypatch):
    """The three modes that are compared share one keyword search and one vector search, and give what each gives alone."""
    calls = []
    for name in ("keyword_search", "vector_search"):
        monkeypatch.setattr(search, name, lambda *a, f=getattr(search, name), name=name, **b: (calls.append(name), f(*a, **b))[1])
    queries, records, runs, _ = work._pooled(spark, DIR)
    assert sorted(calls) == ["keyword_search", "vector_search"]
    for mode, run in runs.items():
        alone = assist.find(queries, records, mode).select("qid", "id", "rank")
        assert {tuple(r) for r in run.collect()} == {tuple(r) for r in alone.collect()}


def test_vectors_added_in_batches(spark):
    """Tokens don't become rows; records of one id count as one text, wherever they are."""
    rows = [(1, "alpha beta"), (2, None), (1, "Gamma alpha"), (3, "alpha beta gamma ALPHA"), (None, "beta"), (4, "ß – ¿")]
    found = search.hash_embedding(spark.createDataFrame(rows, "id int, content string").repartition(3))
    assert "Generate" not in plan(found)
    got = {r["id"]: r["v"] for r in found.collect()}
    assert len(got) == 5 and got[1] == pytest.approx(got[3]) and got[2] == got[4] == [0.0] * 64
    assert sum(x * x for x in got[1]) == pytest.approx(1) and sorted(map(abs, got[None]))[-2:] == [0, 1]


def test_documents_stay(spark):
    records = spark.range(50).select("id", F.lit("x").alias("content"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    keep = assist.stored
    assist.stored = lambda df, name: (plans.append(plan(df)), keep(df, name))[1]
    try:
        found = spark.createDataFrame([(1, 7), (2, 7), (2, 9)], "qid int, id long")
        assert {r["id"] for r in assist.named(records, found).collect()} == {7, 9}
        assert not any("SortMergeJoin" in p for p in plans)
    finally:
        assist.stored = keep
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
