"""Registered queries against brute force over the whole of their input."""

from collections import defaultdict

import pytest

from memspark import catalog
from memspark.operators import search
from memspark.plans import mapping
from memspark.tables import table

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def near(spark):
    """Neighbours and weights of every entity over all edges."""
    found = {r.id: {} for r in mapping.entities(spark, DIR).collect()}
    for r in mapping.relations(spark, DIR).collect():
        found[r.src][r.dst] = found[r.dst][r.src] = r.weight
    return found


def swept(near):
    """Communities by one sweep after another over all nodes in id order."""
    ids, own = sorted(near), {i: i for i in near}
    degree = {i: sum(near[i].values()) for i in ids}
    whole = sum(degree.values())
    for _ in range(100):
        before = dict(own)
        for i in ids:
            total, into = defaultdict(float), defaultdict(float)
            for j in ids:
                if j != i:
                    total[own[j]] += degree[j]
                    into[own[j]] += near[i].get(j, 0.0)
            gain = lambda c: 2 * into[c] / whole - 2 * total[c] * degree[i] / whole**2  # noqa: B023, E731
            best, most = own[i], gain(own[i])
            for c in sorted(set(own[j] for j in near[i])):
                if gain(c) > most + 1e-12:
                    best, most = c, gain(c)
            own[i] = best
        if own == before:
            break
    lowest = {}
    for i in ids:
        lowest.setdefault(own[i], i)
    return {i: lowest[own[i]] for i in ids}


def ranked(near, seeds, damping=0.5, most=50, tolerance=1e-6):
    """Personalised PageRank of ``seeds`` (id to weight) over all edges."""
    seeds = {i: w for i, w in seeds.items() if near.get(i)}
    whole = sum(seeds.values())
    scores = start = {i: w / whole for i, w in seeds.items()}
    for _ in range(most):
        new = defaultdict(float, {i: (1 - damping) * s for i, s in start.items()})
        for i, s in scores.items():
            out = sum(near[i].values())
            for j, w in near[i].items():
                new[j] += damping * s * w / out
        gap = sum(abs(new.get(i, 0.0) - scores.get(i, 0.0)) for i in set(new) | set(scores))
        scores = dict(new)
        if gap < tolerance:
            break
    return scores


def test_communities_of_the_whole_graph(spark, near):
    expected = swept(near)
    assert {r.id: r.community for r in catalog.QUERIES["g4_communities"](spark, DIR).collect()} == expected
    sizes = defaultdict(int)
    for c in expected.values():
        sizes[c] += 1
    got = {r.community: r.size for r in catalog.QUERIES["g9_reflection"](spark, DIR).collect()}
    assert got and got.items() <= sizes.items()


def test_theme_labels_of_the_whole_graph(spark, near):
    reached, todo = set(), [min(near)]
    while todo:
        i = todo.pop()
        if i not in reached:
            reached.add(i)
            todo += near[i]
    labels = {r.community: r.label for r in catalog.QUERIES["f26_theme_labels"](spark, DIR).collect()}
    assert len(labels) == 1 + sum(1 for i in near if i not in reached) and labels[min(reached)].startswith(", ".join(sorted(reached)[:5]))


def test_graph_arm_over_the_whole_graph(spark, near):
    docs, n = [r.doc_id for r in table(spark, DIR, "documents").select("doc_id").collect()], table(spark, DIR, "supplier").count()
    owned = defaultdict(list)
    for d in sorted(docs):
        owned[f"s{d % n + 1}"].append(d)
    hits = search.keyword_search(table(spark, DIR, "benchmark").selectExpr("item_id AS qid", "text AS query"), table(spark, DIR, "documents").selectExpr("doc_id AS id", "text AS content"), 5)
    seeds = defaultdict(lambda: defaultdict(float))
    for r in hits.collect():
        seeds[r.qid][f"s{r.id % n + 1}"] += 1 / r.rank
    expected = set()
    for qid, own in seeds.items():
        scores, rows = ranked(near, own), []
        for e in sorted((e for e in scores if owned[e]), key=lambda e: (-round(scores[e], 9), e)):
            if len(rows) < 10:
                rows += owned[e]
        expected |= {(qid, d, k) for k, d in enumerate(rows, 1)}
    assert {(r.qid, r.id, r.rank) for r in catalog.QUERIES["r5_graph_arm"](spark, DIR).collect()} == expected


def test_slot_conflicts_of_any_distance(spark):
    slots, verdicts = defaultdict(list), ("auto_supersede", "no_conflict", "review")
    for r in table(spark, DIR, "events").orderBy("event_id").collect():
        slots[str(r.user_id), r.event_id % 3].append((r.event_id, r.event_type))
    expected = {(a, b, verdicts[k]) for (_, k), e in slots.items() for i, (a, x) in enumerate(e) for b, y in e[i + 1 :] if x != y}
    assert any(b - a >= 300 for a, b, _ in expected)
    members = defaultdict(list)
    for r in catalog.QUERIES["j12_b2_slot_members"](spark, DIR).collect():
        members[r.subject, r.predicate, r.value].append(r.id)
    got = []
    for r in catalog.QUERIES["j12_b2_slot_value_conflicts"](spark, DIR).collect():
        x, y = members[r.subject, r.predicate, r.value], members[r.subject, r.predicate, r.other]
        assert (len(x), len(y)) == (r.n_value, r.n_other)
        got += [(min(a, b), max(a, b), r.verdict) for a in x for b in y]
    assert len(got) == len(expected) and set(got) == expected


def test_pagerank_of_every_nation(spark, near):
    seeds = defaultdict(dict)
    for r in mapping.entities(spark, DIR).where("entity_type = 'supplier'").collect():
        seeds[r.scope][r.id] = 1.0
    got = defaultdict(dict)
    for r in catalog.QUERIES["g2_pagerank_all"](spark, DIR).collect():
        got[r.qid][r.id] = r.score
    assert len(seeds) > 1 and set(got) == set(seeds)
    for qid, own in seeds.items():
        expected = ranked(near, own)
        assert set(got[qid]) == set(expected) and all(abs(got[qid][i] - x) < 2e-8 for i, x in expected.items())


def test_neighbourhood_of_every_supplier(spark, near):
    expected = set()
    for root in (i for i in near if i[0] == "s"):
        one = set(near[root])
        two = {j for i in one for j in near[i]} - one - {root}
        expected |= {(root, root, 0), *((root, i, 1) for i in one), *((root, i, 2) for i in two)}
    assert {tuple(r) for r in catalog.QUERIES["g1_neighbourhood_all"](spark, DIR).select("root", "id", "distance").collect()} == expected


@pytest.mark.parametrize("name", ["a6_reuse_per_record", "x7_guarded_rows"])
def test_no_group_is_held_in_one_row(spark, name):
    plan = catalog.QUERIES[name](spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(" not in plan.replace("collect_list(_s", "")  # a qid's distinct signals
