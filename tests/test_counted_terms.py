"""Keyword search that counts a record's terms and scores them where the record is."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memspark.operators import postings, search


def test_a_token_is_not_a_row(spark, monkeypatch):
    """No table that a search stores has more rows than there are records or terms of queries, and terms are stemmed where they are counted."""
    rows = {}
    monkeypatch.setattr(postings, "stored", lambda df, name, f=postings.stored: (found := f(df, name), rows.update({name: found.count()}))[0])
    docs = spark.range(20).select("id", F.lit("running cats " * 30).alias("content"))
    queries = spark.createDataFrame([("q", "run cat")], "qid string, query string")
    assert search.keyword_search(queries, docs, 5, stem=True).count() == 5
    assert "stems" not in rows and max(rows.values()) == 20


@pytest.mark.parametrize("stem", [False, True])
def test_scored_in_tasks_as_by_joins(spark, monkeypatch, stem):
    """Phrases, copies beyond k, null and empty texts, records that aren't wanted: scores in tasks are those of the joins, in blocks too."""
    rnd = random.Random(7)
    words = "run running runs cat cats élan elan über hop hopping state a-b a_b b x".split()
    text = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", "-", "_", ", "]) for _ in range(n))
    rows = [(f"d{i}", rnd.choice([text(rnd.randint(1, 25)), "run cats a-b", "", None])) for i in range(150)]
    docs = spark.createDataFrame(rows, "id string, content string").repartition(3)
    queries = spark.createDataFrame([(i, text(6)) for i in range(12)] + [(90, "a-b a_b a-b"), (91, "runs-cat"), (92, "nowhere"), (93, "")], "qid int, query string")
    find = lambda: {(r.qid, r.id, r["rank"]): r.score for r in search.keyword_search(queries, docs, 4, F.col("id") != "d3", stem).collect()}
    whole = find()
    assert any(q == 90 for q, _, _ in whole) and all(i != "d3" for _, i, _ in whole)
    monkeypatch.setattr(postings, "BLOCK_TOKENS", 20)
    monkeypatch.setattr(postings, "BLOCK_CELLS", 50)
    assert find() == whole
    monkeypatch.setattr(postings, "SCORED_QUERIES", 0)
    joined = find()
    monkeypatch.setattr(postings, "BROADCAST_ROWS", 0)
    assert joined == find() == pytest.approx(whole)


def test_records_of_one_id(spark):
    """Records of one id and length count as one, as before; of other lengths, their scores are added up."""
    docs = spark.createDataFrame([(1, "cat x"), (1, "cat y"), (1, "cat"), (2, "cat dog"), *[(i, "other") for i in range(5, 15)]], "id int, content string")
    got = {r.id: r.score for r in search.keyword_search(spark.createDataFrame([("q", "cat")], "qid string, query string"), docs).collect()}
    average, idf = 17 / 14, np.log((14 - 3 + 0.5) / 3.5)
    weight = lambda tf, dl: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))
    assert got == pytest.approx({1: idf * (weight(2, 2) + weight(1, 1)), 2: idf * weight(1, 2)}, abs=2e-6)


def test_best_of_equal_scores(monkeypatch):
    """What is kept has the first k by score and id, and of equal scores no more than k."""
    monkeypatch.setattr(postings, "BLOCK_CELLS", 40)
    rnd = np.random.default_rng(3)
    scores = rnd.integers(0, 4, (300, 3)) / 2
    ids = rnd.permutation(300)
    best = postings._Best(3, 5, pa.int64())
    for at in range(0, 300, 7):
        best.add(pa.array(ids[at : at + 7]), scores[at : at + 7])
    kept, query, score = best.cut()
    for q in range(3):
        want = sorted((-s, i) for s, i in zip(scores[:, q], ids) if s > 0)[:5]
        assert sorted(zip(-score[query == q], kept.to_numpy()[query == q])) == want
