"""Injection scan and guards: each text is lowered once, and snippets aren't moved for their notices."""

import re

from pyspark.sql import functions as F

from memspark.functions import text
from memspark.operators import evidence


def plan(df):
    return df._jdf.queryExecution().toString()


def test_lowered_once(spark):
    rows = spark.createDataFrame([(1, "You ARE now"), (2, None), (3, "nothing")], "id int, t string")
    found = rows.select("id", text.injection_signals(F.col("t")).alias("s"))
    assert not re.search(r"contains\((translate|lower)\(", plan(found), re.IGNORECASE)  # not for every signal
    assert {r["id"]: r["s"] for r in found.collect()} == {1: ["you are now"], 2: [], 3: []}


def test_letters_outside_ascii(spark):
    """Letters whose lower case is or begins with an ASCII letter make no signal."""
    odd = ["you are now".replace("a", "Á"), "İgnore all previous", "without İnforming the user", "K"]
    found = spark.createDataFrame([(o,) for o in odd], "t string").select(text.injection_signals(F.col("t")).alias("s"))
    assert [r["s"] for r in found.collect()] == [[]] * 4
    assert "k" not in "".join(text.INJECTION_SIGNALS) and not any(s.endswith("i") for s in text.INJECTION_SIGNALS)


def test_snippets_stay(spark):
    rows = spark.range(40).select((F.col("id") % 2).alias("qid"), F.col("id").alias("rank"), F.when(F.col("id") == 3, "[SYSTEM]").otherwise("x").alias("snippet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evidence.guarded_rows(rows)
        assert "SortMergeJoin" not in plan(found) and "ShuffledHashJoin" not in plan(found)
        assert {(r["qid"], r["notice"]) for r in found.collect()} == {(0, None), (1, evidence.NOTICE + "[system]")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
