"""Columns of a table that have the names of inner ones, in operators that keep the table's columns or join it."""

import random

from pyspark.sql import functions as F

from memspark.llm import quality_classifier, toxicity
from memspark.llm.minhash import near_duplicates

CLASH = ("_mh_id", "_of", "_vector", "_raw", "_probability", "_prediction", "_p", "_tox_p", "_tox_v", "_tox_raw", "_tox_probability", "_tox_prediction", "features", "prediction")


def texts(n):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice(("ba", "co", "den", "er", "fi", "lu")) for _ in range(rnd.randint(2, 4)))
    rows = []
    for i in range(n):
        t = " ".join(word() for _ in range(40))
        rows.append((i, t + (" you damned stupid fool, you idiot!!" if i % 3 == 0 else " and so on, quietly."), int(i % 3 == 0)))
    return rows


def test_toxicity_keeps_clashing_columns(spark):
    rows = spark.createDataFrame(texts(240), "doc_id long, text string, _toxic int")
    docs, labels = rows.select("doc_id", "text"), rows.select("doc_id", "_toxic")
    model = toxicity.fit(docs, labels)
    plain = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    clash = docs.withColumns({c: F.lit(f"mine {c}") for c in CLASH})
    for r in toxicity.score(clash, model).collect():
        assert r["score"] == plain[r["doc_id"]] and all(r[c] == f"mine {c}" for c in CLASH)


def test_near_duplicates_with_clashing_columns(spark):
    rows = texts(60)
    rows += [(100 + i, t.replace("and so on, quietly.", "and so on, loudly."), y) for i, t, y in rows[:20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int").drop("y")
    plain = sorted(map(tuple, near_duplicates(docs).collect()))
    assert sorted(map(tuple, near_duplicates(docs.withColumns({c: F.lit(1) for c in CLASH})).collect())) == plain


def test_a_sampled_id_counts_once(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts(90)], "doc_id long, text string")
    good = docs.where("doc_id % 3 > 0").select("doc_id")
    once = quality_classifier.fit(docs, good)
    again = quality_classifier.fit(docs.unionByName(docs.where("doc_id = 1")).unionByName(docs.where("doc_id = 1")), good)
    a, b = ({r.doc_id: r.score for r in quality_classifier.score(docs, m).collect()} for m in (once, again))
    assert a == b
