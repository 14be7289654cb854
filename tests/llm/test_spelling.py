"""op12: spelling variants against SQL and a comparison of all pairs."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from memspark.llm.queries.op12_spelling_variants import SQL
from memspark.llm.spelling import near_words, signatures, spelling_variants, variants

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def edited(word, rnd, letters):
    at, how = rnd.randrange(len(word) + 1), rnd.randrange(3)
    rest = word[at + 1 :] if how else word[at:]
    return word[:at] + ("" if how == 1 else rnd.choice(letters)) + rest


def plain(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b))) if len(b) == len(a) + 1 else False

    form, beside = {}, {}
    for w, n in words.items():
        found = [v for v in words if near(w, v)]
        best = min(found, key=lambda v: (-words[v], v), default=None)
        beside[w], form[w] = len(found), best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, beside[w], words[form[w]] if form[w] else None))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzàÿß÷"])
def test_same_as_all_pairs(spark, letters):
    rnd = random.Random(len(letters))
    words = ["".join(rnd.choices(letters, k=rnd.randint(4, 9))) for _ in range(25)]
    for _ in range(120):
        words.append(edited(rnd.choice(words), rnd, letters) or "aaaaa")
    rows = [(i, " ".join(rnd.choice((w, w.title())) for w in rnd.choices(words, weights=[1 + i % 7 for i in range(len(words))], k=60)) + "1\x00A") for i in range(30)]
    rows += [(None, "; ".join(words[:9]) * 3), (None, None), (7, "")]
    got = result(spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain(rows) and any(r[4] for r in got)


def test_pairs_share_a_signature():
    rnd = random.Random(1)
    for letters in ("ab", "etaoinshré"):
        for _ in range(3000):
            word = "".join(rnd.choices(letters, k=rnd.randint(1, 14)))
            other = edited(word, rnd, letters)
            if other and other != word:
                a, b = sorted((word, other), key=len)
                assert {s for own, s in signatures(a) if own} & {s for _, s in signatures(b)}


def test_given_table_as_sql(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    assert result(spelling_variants(df)) == sorted(con.execute(SQL).fetchall())


def test_forms_lead_to_roots(spark):
    counts = [("aaaaa", 3), ("aaaab", 6), ("aaabb", 12), ("aabbb", 24), ("zzzzz", 100), ("zzzzy", 60), ("zzzzy", 39), ("qqqqq", 2), (None, 9), ("short", 3)]
    got = {r[0]: r[1:] for r in result(variants(spark.createDataFrame(counts, "word string, n long")))}
    assert got["aaaaa"] == ("aaaab", "aabbb", 3, 1, 6) and got["aaaab"][1] == "aabbb" and got["aabbb"] == (None, "aabbb", 24, 1, None)
    assert got["zzzzy"] == (None, "zzzzy", 99, 1, None) and "qqqqq" not in got and None not in got
    # ties go to the first in code-point order
    tie = [("abcdz", 3), ("abcde", 9), ("abcdé", 9), ("abcda", 8)]
    assert {r[0]: r[1] for r in result(variants(spark.createDataFrame(tie, "word string, n long")))}["abcdz"] == "abcde"


def test_odd_tables(spark):
    assert result(spelling_variants(spark.createDataFrame([], "doc_id long, text string"))) == []
    df = spark.createDataFrame([(1, "same Word. " * 50_000)] * 2, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_key", "_text", "word", "n", "k")})
    assert result(spelling_variants(df)) == []
    df = spark.createDataFrame([(1, "words " * 50_000)] * 2, "doc_id long, text string")
    assert [r[3] for r in result(spelling_variants(df))] == [100_000]
    assert near_words(spark.createDataFrame([("anagram",), ("nagaram",), ("margana",)], "word string")).count() == 0
