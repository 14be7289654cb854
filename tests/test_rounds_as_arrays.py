"""Rounds of communities: a block's edges don't move as rows, and tables of past rounds don't stay."""

import random
from pathlib import Path

from memspark.operators import communities, stored


def test_edges_are_arrays_and_past_rounds_are_deleted(spark, monkeypatch):
    rnd = random.Random(5)
    edges = [(f"s{i:02d}", f"p{j:02d}", 5.0 if i % 4 == j % 4 else 0.5) for i in range(16) for j in range(64) if i % 4 == j % 4 or rnd.random() < 0.6]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for a, b, _ in edges for x in (a, b)})], "id string")
    kept, keep = {}, communities.stored

    def watched(rows, name):
        kept[name] = keep(rows, name)
        return kept[name]

    tables = lambda: set(Path(stored.shared_dir(spark)).glob("*/moves/_SUCCESS"))
    before = tables()
    monkeypatch.setattr(communities, "stored", watched)
    monkeypatch.setattr(communities, "BLOCK_EDGES", 400)
    found = {r.id: r.community for r in communities.louvain(nodes, df, most_edges=10).collect()}
    assert found == {x: f"p{int(x[1:]) % 4:02d}" for x in found} and len(found) == 80
    assert kept["block_edges"].where("kind = 0").count() <= -(-2 * len(edges) // 400)
    assert len(tables() - before) <= 3  # the state, the one before and what would have come next
