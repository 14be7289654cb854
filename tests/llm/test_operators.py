"""The operators against brute force, and on nulls, empty texts, ties, repeated rows, empty tables and clashing names."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memspark.llm.html_pages import labelled_pages
from memspark.llm.html_text import extract, main_text, parse, trained
from memspark.llm.line_dedup import dedup_lines
from memspark.llm.minhash import near_duplicates
from memspark.llm.mixing import mix_sources
from memspark.llm.packing import pack, plan
from memspark.llm.quality_classifier import fit as fit_quality
from memspark.llm.quality_classifier import score as score_quality
from memspark.llm.quality_rules import apply_rules
from memspark.llm.token_counts import Units, token_counts
from memspark.llm.topk import top_k
from memspark.llm.toxicity import fit as fit_toxicity
from memspark.llm.toxicity import score as score_toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rank int, _id string"
PROSE = "the cat of the house and a dog in it is on the mat with that old hat by the door for you to see. "
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def rows():
    texts = [None, "", " \n\t ", "short", PROSE * 3, PROSE * 3, PROSE.upper() * 2, "漢字 🙂 \x00 é" * 9, "word " * 30_000, "x" * 70_000, "<|endoftext|> a<|startoftext|>"]
    out = [(i, t, "en", "ab"[i % 2] if i % 5 else None, len(t or ""), "s", 1, "i") for i, t in enumerate(texts)]
    return [*out, out[4], (None, PROSE, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


def test_quality_rules(docs, none):
    got = apply_rules(docs).collect()
    assert len(got) == len(rows()) and apply_rules(none).count() == 0
    for r in got:
        w = words(r.text)
        assert r.n_words == len(w) and r.word_chars == sum(map(len, w))
        seen = {}
        for i in range(len(w) - 7):
            seen.setdefault(tuple(w[i : i + 8]), []).append(i)
        covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
        assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and (not r.kept or not r.base_failed)


def test_quality_rules_keep_columns_of_any_name(spark):
    data = spark.createDataFrame([(1, PROSE, "a", "b", "c")], "doc_id long, text string, _t string, _W string, __h string")
    got = apply_rules(data).collect()[0]
    assert (got["_t"], got["_W"], got["__h"]) == ("a", "b", "c") and got.n_words == len(words(PROSE))


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    for r in token_counts(docs.withColumn("key", F.monotonically_increasing_id()), BYTE, 512, key="key").join(docs.withColumn("key", F.monotonically_increasing_id()), "key").collect():
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) and r.n_bytes == len((r.text or "").encode())
    assert token_counts(none, BYTE, 512).count() == 0


def counted(units, texts):
    from memspark.llm.textbatch import slices
    from memspark.llm.token_counts import SLICE

    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    return [n for _, data, offsets in slices(batch, "t", SLICE) for n in units.of_slice(data, offsets).tolist()]


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    library, units, rnd = Tokenizer.from_file(BYTE), Units.of_file(BYTE), random.Random(2)
    letters = [*"abcdetherion '  \n\t\0.,!?0123éß漢字🙂 \x85\x1c_\xa0\u2003\u3000”", "'s", "'ll", "'re", " the", "<|endoftext|>", "<|", "  ", "\n\n", " ", " "]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(3000)]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counted(units, texts) == expected
    units.clear()
    units.chunk = 3  # every pre-token by maps of several chunks
    assert counted(units, texts) == expected


def test_token_counts_of_a_long_text_without_spaces():
    import tracemalloc

    from tokenizers import Tokenizer

    text = "漢字仮名交じり文" * 40_000 + "x" * 100_000
    units = Units.of_file(BYTE)
    assert counted(units, [text[:20_000]]) == [len(Tokenizer.from_file(BYTE).encode(text[:20_000], add_special_tokens=False).ids)]
    tracemalloc.start()
    counted(units, [text])
    assert tracemalloc.get_traced_memory()[1] < 60 * len(text)
    tracemalloc.stop()


def test_plan_fills_every_place_once():
    rnd = random.Random(1)
    for _ in range(40):
        cap = rnd.choice([10, 64, 2048])
        counts = {rnd.randint(1, cap): rnd.choice([1, 2, 3, 50, 2000]) for _ in range(rnd.randint(1, 60))}
        fill, seen = {}, {}
        for r in plan(counts, cap):
            assert r.lo == seen.get(r.length, 0)
            seen[r.length] = r.lo + r.each * r.sequences
            for b in range(r.first, r.first + r.sequences):
                fill.setdefault(b, []).append((r.offset, r.offset + r.each * r.length))
        assert seen == counts
        for v in fill.values():
            v.sort()
            assert v[0][0] == 0 and all(x[1] == y[0] for x, y in zip(v, v[1:])) and v[-1][1] <= cap


def test_packing(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    got = pack(docs, WORD, 64).collect()
    expected = []
    for doc_id, text, *_ in rows():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 64):
            piece = ids[k : k + 64]
            expected.append((doc_id, k // 64, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())))
    key = lambda x: (x[0] is None, x)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(expected, key=key)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    for v in places.values():
        v.sort()
        assert v[0][0] == 0 and all(x[1] == y[0] for x, y in zip(v, v[1:])) and v[-1][1] <= 64
    assert pack(none, WORD, 64).count() == 0


def test_packing_ids_of_odd_texts(monkeypatch):
    from tokenizers import Tokenizer

    from memspark.llm import packing
    from memspark.llm.textbatch import slices

    library, known, rnd = Tokenizer.from_file(WORD), packing.WordIds(WORD, 0), random.Random(2)
    letters = [*"abcdetherion '  \n\t\0.,!?0123éßİΣςǅ漢字🙂 \x85\x1c_ØȺ²½\u0301\xa0“…€ﬁ", "'s", "'ll", "'re", " the", "<|endoftext|>", "  ", "\n\n", "--", "''s", "\"'ve"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(1500)]
    texts += ["", " ", "a", "'", "'s", "a'", "x" * 70, "x" * 300, "é" * 64, "1" * 100, "漢" * 50 + " a " * 3]

    def check(texts):
        batch = packing.pa.RecordBatch.from_arrays([packing.pa.array(texts)], names=["t"])
        got = [ids[a:b].tolist() for _, data, offsets in slices(batch, "t", packing.SLICE) for ids, at in [known.of_slice(data, offsets)] for a, b in zip(at, at[1:])]
        assert got == [[*e.ids, 0] for e in library.encode_batch(texts, add_special_tokens=False)]

    check(texts)
    monkeypatch.setattr(packing, "SLICE", 500)  # texts of several parts
    check(["".join(rnd.choice(letters) for _ in range(4000)) for _ in range(8)])


def test_packing_is_near_the_least_number_of_sequences():
    rnd = random.Random(7)
    for top in (700, 2048):
        counts = {}
        for _ in range(20_000):
            n = min(top, max(1, int(rnd.paretovariate(0.8) * 20)))
            counts[n] = counts.get(n, 0) + 1
        used = {b for r in plan(counts, 2048) for b in range(r.first, r.first + r.sequences)}
        least = -(-sum(k * n for k, n in counts.items()) // 2048)
        assert len(used) <= 1.01 * least + 1


def shingles(t):
    w = words("".join(c.lower() if c.isascii() else c for c in t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_rows():
    """Documents by id, with chains, small groups and texts without words; and each one's smallest reachable id by brute force."""
    rnd = random.Random(4)
    base = [[rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(60)] for _ in range(6)]
    texts = []
    for _ in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = "zz"
        texts.append(" ".join(w))
    texts += ["", None, "a b", "A b", "  "]
    data = list(enumerate(texts))
    sets = {d: shingles(t) for d, t in data}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return data, sets, {d: find(d) for d in sets}


@pytest.mark.parametrize("stars", [True, False])
def test_near_duplicates(spark, monkeypatch, stars):
    from memspark.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 8)
    if not stars:  # the second comparison must find every link by itself
        confirmed = minhash._confirmed
        monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *args: confirmed(pairs.where("false"), *args))
    data, sets, least = near_rows()
    got = near_duplicates(spark.createDataFrame([*data, (None, data[0][1])], "doc_id long, text string")).collect()
    assert len(got) == len(data) + 1
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), least[r.doc_id], least[r.doc_id] == r.doc_id)


def test_near_duplicates_odd_rows(docs, none):
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    assert got[5].component_id == 4 and not got[5].kept and got[4].kept and got[0].kept and got[0].n_shingles == 0
    assert near_duplicates(none).count() == 0


def test_lines(spark, docs, none):
    def within(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        p = q = 0
        while p < min(len(a), len(b)) and a[p] == b[p]:
            p += 1
        while q < min(len(a), len(b)) and a[-1 - q] == b[-1 - q]:
            q += 1
        return p + q >= max(len(a), len(b)) - 1

    rnd = random.Random(5)
    base = ["".join(rnd.choice("abé d") for _ in range(n)) for n in (1, 2, 3, 5, 24, 31, 32, 33, 63, 64, 65, 129, 200, 1100)]
    data = []
    for d in range(100):
        lines = []
        for _ in range(rnd.randint(0, 5)):
            t = rnd.choice(base)
            for _ in range(rnd.choice((0, 1, 1, 2))):
                i = rnd.randrange(len(t) + 1)
                t = rnd.choice((t[:i] + rnd.choice("abé") + t[i:], t[: max(i - 1, 0)] + t[i:], t[: max(i - 1, 0)] + "x" + t[i:]))
            lines.append(t)
        data.append((d, "\n".join(lines)))
    order = [(d, i, x) for d, t in data for i, x in enumerate(t.split("\n")) if x.strip()]
    gone = {(d, i) for k, (d, i, x) in enumerate(order) if any(within(x, y) for _, _, y in order[:k])}
    expected = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in data}
    assert {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(data, "doc_id long, text string")).collect()} == expected
    got = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert got[0].text is None and got[0].n_lines == 0 and got[1].text == "" and got[5].n_removed == 1 and got[4].n_removed == 0
    assert dedup_lines(none).count() == 0


def test_mixing(docs, none, spark):
    rnd = random.Random(3)
    big = spark.createDataFrame([(i, "w " * rnd.choice((0, 1, 5, 40, 300)), rnd.choice(("a", "a", "a", "b", "c", None))) for i in range(1500)], "doc_id long, text string, source string")
    got = mix_sources(big).collect()
    per = {}
    for r in got:
        p = per.setdefault(r.source, [0, 0, r.target])
        p[0], p[1] = p[0] + r.size, p[1] + r.taken
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    names = sorted(n for n in per if n) + [None]
    weight, stop, total = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, {}, sum(p[0] for p in per.values())
    while True:
        free = [n for n in names if n not in stop]
        level = (total - sum(stop.values())) / sum(weight[n] for n in free)
        above = [n for n in free if level * weight[n] > 3 * per[n][0]]
        if not above:
            break
        stop |= {n: 3 * per[n][0] for n in above}
    for n in names:
        target = stop.get(n, level * weight[n])
        assert abs(per[n][2] - target) < 1e-6 and abs(per[n][1] - target) <= 300
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(big).collect()))
    assert mix_sources(docs).count() == len(rows()) and mix_sources(none).count() == 0


def test_top_k(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(300, 8))
    v[7], v[8] = v[9], v[9]
    data = [(i, [float(x) for x in row], 0) for i, row in enumerate(v)] + [(400, None, 0), (401, [None] * 8, 0), (402, [float("nan")] * 8, 0), (403, [1.0] * 3, 0), (None, [1.0] * 8, 0)]
    got = top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>, rank int"), every=20, k=5).collect()
    q = np.floor(64 * v).astype(int)
    expected = []
    for i in range(0, 300, 20):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(300) if j != i)[:5]
        expected += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_top_k_of_large_components(spark, monkeypatch):
    from memspark.llm import topk

    monkeypatch.setattr(topk, "SHARD_CELLS", 256)
    monkeypatch.setattr(topk, "CHUNK_CELLS", 12)
    rnd = random.Random(2)
    for size in (1e3, 1e8, 1e15):
        data = [(i, [rnd.choice((1, 1, 9, 40)) * rnd.uniform(-size, size) for _ in range(4)]) for i in range(200)]
        q = {i: [int(np.floor(64 * x)) for x in v] for i, v in data}
        top = lambda x: min(max(x, 1 - 2**63), 2**63 - 1)
        expected = []
        for i in range(0, 200, 20):
            best = sorted((-top(sum(a * b for a, b in zip(q[i], q[j]))), j) for j in q if j != i)[:3]
            expected += [(i, n, j, -s) for n, (s, j) in enumerate(best, 1)]
        got = top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), every=20, k=3).collect()
        assert sorted(map(tuple, got)) == sorted(expected)


def test_html(spark):
    model = trained()
    page = "<html><head><title>x</title></head><body><nav><a href=/>Home</a></nav><div class='ad'>Buy it now, good people.</div><article><h1>One &amp; two</h1><p>First <b>paragraph\n of</b> a story, told in many words.<br><p>Second one.</article><script>var a='</p>';</script><div class=comments><p>I liked this one very much, thank you all.</p></div><footer>&copy; me</footer>"
    assert main_text(page, model) == "One & two\n\nFirst paragraph of a story, told in many words.\n\nSecond one."
    wrong = total = 0
    for p, labels in labelled_pages(seed=99, pages=120):
        nodes = parse(p, labels)
        for n, q in zip(nodes, model.marginals(nodes), strict=True):
            if n.text is not None:
                total, wrong = total + 1, wrong + ((q > 0.5) != bool(n.label))
    assert wrong < 0.03 * total
    odd = [None, "", "<", "plain words", "<p" * 500, "<div>" * 3000 + "deep" + "</div>" * 3000, page, page]
    odd += ["<p class='y=mx'>one</p>", "<p id='y=-1' class='y='>two</p>", "<li>" * 20_000, "</b></p></q>" * 20_000, "<p class='\x001'>three</p>"]
    got = extract(spark.createDataFrame([(i, "u", t) for i, t in enumerate(odd)], "page_id long, url string, html string")).collect()
    assert len(got) == len(odd) and got[0].text == "" and got[6].text == got[7].text and all(r.n_chars == len(r.text) for r in got)


def test_html_marginals_by_enumeration():
    import itertools

    from memspark.llm.html_text import Node

    model, rnd = trained(), random.Random(5)
    names = sorted(model.likelihood)
    from memspark.llm.html_text import LABELS

    for _ in range(25):
        nodes = [Node(-1, (), None, None)]
        for i in range(1, rnd.randint(2, 6)):
            nodes.append(Node(rnd.randrange(i), tuple(rnd.sample(names, rnd.randint(0, 3))), None, None))
        total, content = 0.0, [0.0] * len(nodes)
        for y in itertools.product(range(LABELS), repeat=len(nodes)):
            p = 0.0
            for i, n in enumerate(nodes):
                p += model.edges[y[n.parent], y[i]] if i else 0.0
                for f in n.features:
                    p += model.likelihood[f][min(y[i], 1)]
            p = np.exp(p)
            total += p
            content = [c + p * (x > 0) for c, x in zip(content, y)]
        assert np.allclose(model.marginals(nodes), [c / total for c in content], atol=1e-9)


def test_html_thousands_of_children_by_enumeration():
    """A root with many leaves: its label is summed over, each leaf's given it. The order of the leaves doesn't matter."""
    from memspark.llm.html_text import LABELS, Node

    model, rnd = trained(), random.Random(6)
    names = sorted(model.likelihood)
    leaves = [tuple(rnd.sample(names, 2)) for _ in range(4000)]
    own = np.array([[sum(model.likelihood[f][min(c, 1)] for f in leaf) for c in range(LABELS)] for leaf in leaves])
    given = np.logaddexp.reduce(model.edges[None, :, :] + own[:, None, :], axis=2)  # of a leaf, by the root's label
    root = given.sum(axis=0)
    rest = root[None, :] - given
    joint = rest[:, :, None] + model.edges[None, :, :] + own[:, None, :]
    by_label = np.logaddexp.reduce(joint, axis=1)
    expected = np.logaddexp.reduce(by_label[:, 1:], axis=1) - by_label[:, 0]
    tree = lambda order: [Node(-1, (), None, None), *(Node(0, leaves[i], None, None) for i in order)]
    straight = model.log_odds([tree(range(4000))])[0]
    assert np.allclose(straight[1:], expected, atol=1e-6)
    order = rnd.sample(range(4000), 4000)
    one, _ = model.log_odds([tree(order), tree(order[:9])])
    assert np.allclose(one[1:], expected[order], atol=1e-6)


@pytest.mark.parametrize("n", [1, 50, 100, 400])
def test_html_keeps_articles_among_many_links(n):
    model = trained()
    paragraph = "<p>" + "A sentence that goes on and on, with several words in it. " * 4 + "</p>"
    items = "".join(f"<li><a href='/x'>link {i}</a></li>" for i in range(n))
    for body in (paragraph * 20 + items, items + paragraph * 20, paragraph * 10 + items + paragraph * 10):
        found = main_text(f"<html><body><nav><a href='/'>Home</a></nav><article><h1>A heading of it</h1>{body}</article><footer>&copy; me</footer></body></html>", model)
        assert found.count("A sentence") == 80 and found.count("link") <= (n if n < 9 else 0)


def test_html_order_of_siblings():
    model = trained()
    long, items = "<p>" + "word " * 40 + ".</p>", "".join(f"<li><a href='/x'>go {i}</a></li>" for i in range(1500))
    for body in (items + long * 3000, long * 3000 + items):
        found = main_text(f"<html><body><div>{body}</div></body></html>", model)
        assert found.count("word") == 120_000 and "go" not in found


def test_html_comments_without_telling_names():
    model = trained()
    paragraph = "<p>" + "A sentence that goes on and on, with several words in it. " * 4 + "</p>"
    talk = "<div><h3>3 comments</h3>" + "".join(f"<div><span>bob {i}</span><p>I think this is a nice one, thank you.</p></div>" for i in range(3)) + "</div>"
    for page in (f"<article><h1>A heading</h1>{paragraph * 4}{talk}</article>", f"<article><h1>A heading</h1>{paragraph * 4}</article>{talk}", f"<article><h1>A heading</h1>{paragraph * 4}<div class='comments'>{paragraph}</div></article>"):
        found = main_text(f"<html><body>{page}</body></html>", model)
        assert found.count("A sentence") == 16 and "nice" not in found


def test_html_depth_costs_its_length():
    import time

    began = time.perf_counter()
    main_text("<div>" * 40_000 + "deep" + "</div>" * 40_000 + "</p>" * 40_000 + "<li>" * 40_000, trained())
    assert time.perf_counter() - began < 20


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(6)
    clean = lambda n: " ".join("".join(rnd.choice(("ba", "co", "den", "er", "fi")) for _ in range(rnd.randint(1, 3))) + rnd.choice(("", "", ".")) for _ in range(n))
    data = []
    for i in range(600):
        t = clean(rnd.randint(20, 90))
        good, toxic = rnd.random() < 0.75, rnd.random() < 0.3
        if not good:
            t = rnd.choice((t.upper().replace(" ", "!! "), t.replace(" ", "### "), " | ".join(t.split()), "ba " * 60))
        if toxic:
            w = t.split(" ")
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(("frubel", "grotzig", "idiot")))
            t = " ".join(w)
        data.append((i, t, int(good), int(toxic)))
    return spark.createDataFrame(data, "doc_id long, text string, quality int, toxic int")


def _agreement(df, label):
    got = df.where("doc_id % 3 = 0").select("score", label).collect()
    return sum((r.score >= 0.5) == bool(r[label]) for r in got) / len(got)


def test_quality_classifier(labelled, docs, none):
    model = fit_quality(labelled, labelled.where("quality = 1 AND doc_id % 3 > 0").select("doc_id"))
    assert 0.5 < model.prior < 0.95
    assert _agreement(score_quality(labelled, model), "quality") > 0.9
    got = score_quality(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got) and got[0].score == got[1].score
    assert score_quality(none, model).count() == 0 and fit_quality(none, none.select("doc_id")) is None
    assert {r.score for r in score_quality(docs, None).collect()} == {1.0}


def test_toxicity(labelled, docs, none):
    known = labelled.where("doc_id % 3 > 0").select("doc_id", F.col("toxic").alias("_toxic"))
    model = fit_toxicity(labelled, known)
    assert _agreement(score_toxicity(labelled, model), "toxic") > 0.95
    got = score_toxicity(docs.withColumn("prediction", F.lit(1)), model).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert score_toxicity(none, model).count() == 0 and fit_toxicity(none, known.where("false")) is None


def test_toxicity_calibrates_on_rows_that_the_trees_have_not_seen(labelled, monkeypatch):
    from memspark.llm import toxicity

    rows = {}

    def counted(owner, name, at):
        inner = getattr(owner, name)

        def run(*args):
            rows[name, owner] = args[at].count()
            return inner(*args)

        monkeypatch.setattr(owner, name, run)

    counted(toxicity, "learn_lexicon", 0)
    counted(toxicity.GBTClassifier, "fit", 1)
    counted(toxicity.IsotonicRegression, "fit", 1)
    assert toxicity.fit(labelled, labelled.select("doc_id", F.col("toxic").alias("_toxic")))
    assert len(rows) == 3 and sum(rows.values()) == labelled.select("toxic", "text").distinct().count()


def test_risk_gradients_by_finite_differences():
    from memspark.llm.quality_classifier import Network, gradients, risk

    rnd = np.random.default_rng(4)
    for prior, shift in ((0.5, 0.0), (0.95, 3.0)):
        net = Network(np.zeros(5), np.ones(5), rnd.normal(size=(5, 3)), rnd.normal(size=3), rnd.normal(size=3), np.zeros(1))
        p, u = rnd.normal(size=(30, 5)), rnd.normal(size=(40, 5))
        if shift:  # positives score high and unlabelled texts low
            net = net._replace(w1=np.abs(net.w1), w2=np.abs(net.w2) + 1)
            p, u = p + shift, u - shift
        below = risk(net, p, u, prior)[1] < 0
        assert below == (shift > 0)
        wanted = lambda: -risk(net, p, u, prior)[1] if below else sum(risk(net, p, u, prior))  # noqa: B023, E731
        for w, g in zip(net[2:], gradients(net, p, u, prior), strict=True):
            for at in np.ndindex(w.shape):
                was = w[at]
                w[at] = was + 1e-5
                up = wanted()
                w[at] = was - 1e-5
                down = wanted()
                w[at] = was
                assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_toxicity_features_slowly():
    from memspark.llm.toxicity import FEATURES, INSULTS, SECOND_PERSON, Lexicon, _hashes, features

    letters = re.compile("[A-Za-z0-9\\x80-\U0010ffff@$*]+")
    plain = str.maketrans("013457@$", "oieastas")
    rnd = random.Random(3)
    words_ = ["You", "1diot", "st*pid", "cat", "HOUSE", "frubel", "frubelish", "ti", "é", "2024", "dein", "x" * 30, "t@ble"]
    texts = ["", "you idiot!", *[" ".join(rnd.choice(words_) + rnd.choice(("", "!", "?", ".", ",")) for _ in range(rnd.randint(1, 60))) for _ in range(60)]]
    h = _hashes(["frubel"])
    raw = [t.encode() for t in texts]
    got = features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), Lexicon(h, np.array([2.5])))
    assert got.shape == (len(texts), FEATURES)
    for t, x in zip(texts, got, strict=True):
        w = letters.findall(t)
        low = ["".join(c.lower() if c.isascii() else c for c in v.translate(plain)) for v in w]
        n, size = max(len(w), 1), max(len(t.encode()), 1)
        lex, insult, person = [v == "frubel" for v in low], [v in INSULTS for v in low], [v in SECOND_PERSON for v in low]
        near = [(a or b) and any(person[max(0, i - 5) : i + 6]) for i, (a, b) in enumerate(zip(lex, insult, strict=True))]
        signs = [sum(c in "*@$0123456789" for c in v) for v in w]
        mixed = sum(0 < k < len(v.encode()) for k, v in zip(signs, w, strict=True))
        expected = [
            sum(lex) / n, np.log1p(sum(lex)), 2.5 * sum(lex) / n, np.log1p(2.5 * sum(lex)), sum(insult) / n, np.log1p(sum(insult)), sum(near) / n, np.log1p(sum(near)), sum("A" <= c <= "Z" for c in t) / size,
            t.count("!") / n, t.count("?") / n, sum(c in ".,;:!?\"'()-" for c in t) / n, mixed / n, sum(len(v.encode()) > 25 for v in w) / n,
        ]
        assert np.allclose(x, expected), (t, x, expected)


def test_mean_copies_are_the_probabilities(spark):
    data = [(1000 * s + i, "w " * (6 + i % 3), f"s{s:03}") for s in range(240) for i in range(18)]
    got = mix_sources(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    for weight in range(3):  # sources of one weight have equal targets
        rows = [r for r in got if int(r.source[1:]) % 3 == weight]
        ratio = rows[0].target / rows[0].source_size
        for i in range(18):
            copies = [r.copies for r in rows if r.doc_id % 1000 == i]
            share = ratio - int(ratio)
            assert len(copies) == 80 and abs(sum(copies) / 80 - ratio) <= 4 * (share * (1 - share) / 80) ** 0.5 + 1 / 18


@pytest.mark.parametrize("name", ["op7_quality_rules", "op8_exact_topk", "op9_line_dedup"])
def test_same_rows_as_sql(spark, name):
    import duckdb

    from memspark.llm import catalog

    folder, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    expected = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(map(str, expected.fetchall())) == sorted(str(tuple(r)) for r in catalog.QUERIES[name](spark, folder).select(*names).collect())
