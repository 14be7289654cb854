"""Cited answers with the state of the question's scope and the number of pending candidates."""

from pyspark.sql import functions as F

from memspark.plans import assist


def test_answers_hold_what_the_scope_sees(spark):
    asked = spark.createDataFrame([(1, " why? ", "a/b", "codex"), (2, "what", "z", " "), (3, "  ", "a", "x"), (4, "how", None, None)], "qid int, query string, scope string, agent string")
    found = spark.createDataFrame(
        [(1, "r1", "decision", "T1", "a", "s1", 1), (1, "r2", "entity", "T2", "", "s2", 2), (1, "r3", "entity", "T3", "", "s3", 3), (9, "r9", "entity", "T", "", "s", 1), (3, "r1", "decision", "T1", "a", "s1", 1)],
        "qid int, id string, record_type string, title string, scope string, snippet string, rank int",
    )
    rows = spark.createDataFrame([("a", "w1", 1), ("a/b", "w2", 2), ("a/b", "w3", 3), ("y", "w4", 4)], "scope string, title string, at int")
    sections = {"Active work": (rows, F.col("title"), [F.col("at").desc()], 2), "Recent decisions": (rows.where("at > 9"), F.col("title"), [F.col("at").desc()], 2)}
    candidates = spark.createDataFrame([("a", "pending")] * 250 + [("z", "pending"), ("z", "approved"), ("z", "pending")], "scope string, status string")
    evidence = spark.createDataFrame([("r1", 2, "e2"), ("r1", 1, "e1"), ("r1", 3, "e3"), ("r2", 1, "e9")], "id string, created_at int, uri string")
    got = assist.scoped_answers(asked, found, sections, candidates, evidence, 2)
    assert {tuple(r) for r in got["rejected"].collect()} == {(3, "question is required")}
    answers = {r.qid: r.answer for r in got["answers"].collect()}
    assert answers == {
        1: "Asked: why?\nActive work: w3; w2.\nMost relevant:\n- [decision] T1 (a) — s1 Evidence: e1, e2\n- [entity] T2 (global) — s2 Evidence: e9\nPending review: 200.",
        2: "Asked: what\nNothing is known about this.\nPending review: 2.",
        4: "Asked: how\nNothing is known about this.",
    }
    audit = {r.qid: (r.agent, r.question, r.scope, r.returned_ids) for r in got["audit"].collect()}
    assert audit == {1: ("codex", "why?", "a/b", ["decision:r1", "entity:r2", "entity:r3"]), 2: ("unknown", "what", "z", []), 4: ("unknown", "how", "", [])}
