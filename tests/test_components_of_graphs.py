"""Graph operators that work component by component, against the same work over all tasks."""

import pytest

from memspark.operators import graph

EDGES = [("a", "b", 2.0), ("b", "c", 1.0), ("a", "c", 3.0), ("d", "e", 1.0), ("e", "f", 5.0), ("g", "g", 1.0), ("h", "i", None)]
SEEDS = [("q", "a", 1.0), ("q", "d", 2.0), ("q", "g", 1.0), ("r", "e", 1.0), ("s", "g", 3.0), ("t", "nowhere", 1.0), ("u", "h", 1.0), ("u", "a", 4.0)]


def brute(most):
    """Rounds over all nodes, mass at nodes without edges back to the seeds."""
    near = {}
    for a, b, w in EDGES:
        if a != b:
            near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w or 1.0
    nodes = {x for a, b, _ in EDGES for x in (a, b)}
    out = {}
    for q in {q for q, *_ in SEEDS}:
        mine = {i: w for x, i, w in SEEDS if x == q and i in nodes}
        seed = {i: w / sum(mine.values()) for i, w in mine.items()}
        x = dict(seed)
        for _ in range(most if seed else 0):
            back = 0.5 + 0.5 * sum(v for i, v in x.items() if i not in near)
            new = {i: back * v for i, v in seed.items()}
            for i, v in x.items():
                for j, w in near.get(i, {}).items():
                    new[j] = new.get(j, 0.0) + 0.5 * v * w / sum(near[i].values())
            x = new
        out |= {(q, i): v for i, v in x.items()}
    return out


def ranks(spark, **how):
    found = graph.pagerank(spark.createDataFrame(SEEDS, "qid string, id string, weight double"), spark.createDataFrame(EDGES, "src string, dst string, weight double"), **how)
    return {(r.qid, r.id): r.score for r in found.collect()}


@pytest.mark.parametrize(("most", "largest"), [(3, 0), (2, 6), (3, 2_000_000), (50, 2_000_000)])
def test_ranks_by_components_and_by_joins(spark, monkeypatch, most, largest):
    monkeypatch.setattr(graph, "RANKED_EDGES", largest)
    monkeypatch.setattr(graph, "RANKED_ROWS", 4)  # several tasks for a component
    got, want = ranks(spark, most=most, tolerance=0.0), brute(most)
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-9)


def test_rounds_of_ranks_in_small_components_store_nothing(spark, monkeypatch):
    names, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or keep(df, name))
    ranks(spark)
    assert "scores" not in names


def test_partitions_of_edges_grow_with_their_rows(spark, monkeypatch):
    from memspark.operators import stored

    monkeypatch.setattr(stored, "PARTITION_ROWS", 100)
    edges = spark.range(1000).selectExpr("concat('s', id) AS src", "concat('p', id % 7) AS dst", "1.0 AS weight")
    both = graph.symmetric(edges)
    assert both.rdd.getNumPartitions() == 20 and both.count() == 2000
