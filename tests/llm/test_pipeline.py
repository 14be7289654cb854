"""The pipeline on a small folder: every stage against what its operator's rule says, and its columns."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice(("ba", "co", "den", "er", "fi", "lu")) for _ in range(rnd.randint(1, 3)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(rnd.randint(8, 30))) + "." for _ in range(rnd.randint(2, 5)))
    data, labels, shared = [], [], "This is a line that many of the documents share."
    for i in range(300):
        t = prose()
        junk = rnd.random() < 0.25
        if junk:
            t = t.upper().replace(" ", "!! ")
        elif rnd.random() < 0.3:
            t += "\n" + shared
        elif rnd.random() < 0.2 and data:
            t = rnd.choice([d for d, q in zip(data, labels, strict=True) if q[1]])[1]
        data.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, int(not junk), 0))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, {r[0]: r[1] for r in data}, {r[0]: r[1] for r in labels}


def test_stages(spark, folder, tmp_path):
    path, texts, quality = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.schema, []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        kept.append(docs.collect())
        if n < len(corpus_pipeline.STAGES) - 1:
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in columns]
    accepted = {r.doc_id for r in kept[0]}
    assert sum((d in accepted) == bool(q) for d, q in quality.items()) > 0.95 * len(quality)
    assert all(d in accepted for d, q in quality.items() if q)
    seen, expected = set(), {}
    for d in sorted(accepted):
        lines = [x for x in texts[d].split("\n") if not x.strip() or x not in seen]
        seen |= {x for x in texts[d].split("\n") if x.strip()}
        if len(lines) == len(texts[d].split("\n")) or "".join(lines).strip():
            expected[d] = "\n".join(lines)
    assert {r.doc_id: r.text for r in kept[1]} == expected and all(r.n_chars == len(r.text) for r in kept[1])
    assert {r.doc_id for r in kept[2]} <= set(expected) and len(kept[2]) == len({r.doc_id for r in kept[2]})
    times = {}
    for r in kept[3]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert set(times) <= {r.doc_id for r in kept[2]} and max(times.values()) <= 3
    pieces = {}
    for r in kept[4]:
        if r.piece == 0:
            pieces[r.doc_id] = pieces.get(r.doc_id, 0) + 1
    assert pieces == times


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0


def test_near_copies_at_80_percent_go(spark, folder):
    words = [f"w{i}" for i in range(104)]
    texts = [" ".join(words), " ".join([f"x{i}" for i in range(10)] + words[10:]), " ".join([f"y{i}" for i in range(18)] + words[18:])]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(100)} for t in texts]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.80 <= like(0, 1) < 0.85 and like(0, 2) < 0.80
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, folder[0]).collect()} == {0, 2}


CLASHING = "_id string, _copies int, _gone string, _score string, n_lines string, n_removed int, _nth int, _lines int, source2 string"


@pytest.fixture(scope="module")
def odd(spark, folder):
    """Rows of every kind beside the clean ones: nulls in all columns, empty and long texts, repeated rows, columns of inner names."""
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    more, good = ("i", 1, "g", "s", "n", 2, 3, 4, "t"), folder[1][0]
    rows = [(1000, None, None, None, None), (1001, "", "en", "s1", 0), (1002, " \n\t", "en", "s1", 3), (1003, "word " * 40_000, "en", "s2", 200_000), (None, good, "en", "s0", None), (None, None, None, None, None)]
    rows += [(1004, good + "\nanother tail line of this text", "en", "s1", len(good))] * 4
    clean = spark.read.parquet(f"{folder[0]}/documents.parquet").collect()
    return spark.createDataFrame([(*r, *more) for r in [*rows, *map(tuple, clean)]], schema)


@pytest.mark.parametrize("n", range(4))
def test_stages_take_odd_rows(spark, folder, odd, n):
    stage = corpus_pipeline.STAGES[n][1]
    out = stage(spark, odd, folder[0])
    assert out.schema.simpleString() == odd.schema.simpleString()
    got = out.collect()
    assert got and all((r["_id"], r["_copies"], r["_gone"], r["_score"], r.n_lines, r.n_removed, r["_nth"], r["_lines"]) == ("i", 1, "g", "s", "n", 2, 3, 4) for r in got)
    assert stage(spark, odd.where("false"), folder[0]).collect() == []


def test_odd_rows_are_packed(spark, folder, odd):
    got = corpus_pipeline.packing(spark, odd, folder[0]).where("piece = 0")
    assert got.count() == odd.count()


def test_rows_of_one_id_share_their_copies(spark, folder):
    text = " ".join(f"w{i}" for i in range(50))
    data = [(1, text, "en", "a", 1)] * 4 + [(i, text, "en", "a", 1) for i in range(2, 12)] + [(i, text, "en", "b", 1) for i in range(20, 60)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    from memspark.llm.mixing import mix_sources

    wanted = {r.doc_id: r.n for r in mix_sources(docs).groupBy("doc_id").agg({"copies": "sum"}).toDF("doc_id", "n").collect() if r.n}
    assert {r.doc_id: r["count"] for r in corpus_pipeline.mix(spark, docs, folder[0]).groupBy("doc_id").count().collect()} == wanted
