"""Keyword search in the scopes that a query sees, scored where the records are."""

from memspark.operators import postings, search


def test_scoped_search_makes_no_pairs_and_finds_the_same(spark, monkeypatch):
    rows = [(i, f"alpha {'beta ' * (i % 3)}gamma{i % 5} delta", [None, "", "x", "y", "z"][i % 5]) for i in range(60)]
    records = spark.createDataFrame(rows, "id int, content string, scope string")
    queries = spark.createDataFrame([(1, "beta gamma1"), (2, "gamma2 delta"), (3, "gamma3 beta"), (4, "nothing")], "qid long, query string")
    allowed = spark.createDataFrame([(1, "x"), (1, "y"), (1, "x"), (2, ""), (2, "elsewhere"), (None, "x"), (3, None), (4, "x"), (9, "x")], "qid long, scope string")
    names, keep = [], postings.stored
    monkeypatch.setattr(postings, "stored", lambda df, name: names.append(name) or keep(df, name))
    got = {(r.qid, r.rank): (r.id, r.score) for r in search.keyword_search(queries, records, 4, allowed=allowed).collect()}
    assert not {"sums", "candidates", "terms_cut"} & set(names)
    monkeypatch.setattr(postings, "BLOCK_CELLS", 0)
    assert got == {(r.qid, r.rank): (r.id, r.score) for r in search.keyword_search(queries, records, 4, allowed=allowed).collect()}
    assert {q for q, _ in got} == {1, 2} and {rows[i][2] for i, _ in got.values()} <= {"x", "y", ""}
