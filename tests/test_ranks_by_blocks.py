"""PageRank of large components in blocks of edges, and components found by joining neighbours."""

import random
from pathlib import Path

import pytest

from memspark.operators import graph, stored
from tests.test_components_of_graphs import SEEDS, brute, ranks


@pytest.mark.parametrize("most", [0, 4])
def test_ranks_by_blocks_keep_one_round_on_disk(spark, monkeypatch, most):
    for name, value in {"RANKED_EDGES": 0, "LEAST_EDGES": 1, "BLOCKS": 3, "BLOCK_QUERIES": 2}.items():
        monkeypatch.setattr(graph, name, value, raising=False)
    tables = lambda: set(Path(stored.shared_dir(spark)).glob("*/scores/_SUCCESS"))
    before = tables()
    got, want = ranks(spark, most=most, tolerance=0.0), brute(most)
    if most:
        assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-12)
    assert len(tables() - before) <= 1
    among = spark.createDataFrame([("a",), ("e",), ("g",), ("nowhere",)], "id string")
    assert ranks(spark, most=most, tolerance=0.0, among=among) == pytest.approx({k: v for k, v in got.items() if k[1] in "aeg"}, abs=1e-12)
    assert len(SEEDS) == 8


def test_components_of_a_path_take_few_rounds(spark, monkeypatch):
    names, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or keep(df, name))
    rnd = random.Random(3)
    groups = [[f"n{g}{i:03d}" for i in range(150)] for g in range(2)]
    edges = [(a, b, 1.0) for ids in groups for a, b in zip(ids, ids[1:], strict=False)]
    rnd.shuffle(edges)
    nodes = spark.createDataFrame([(i,) for ids in groups for i in ids] + [("alone",)], "id string")
    got = {r.id: r.component for r in graph.components(nodes, spark.createDataFrame(edges, "src string, dst string, weight double")).collect()}
    assert got == {"alone": "alone"} | {i: ids[0] for ids in groups for i in ids}
    assert names.count("pairs") <= 12
