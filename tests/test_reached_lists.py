"""What roots reach, by lists of numbered nodes, against a plain search."""

import random

import pytest

from memspark.operators import graph


def reached(root, pairs, depth):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    seen, edge = {root: 0}, {root}
    for step in range(1, depth + 1):
        edge = {y for x in edge for y in near.get(x, ())} - seen.keys()
        seen |= dict.fromkeys(edge, step)
    return {(root, x, d) for x, d in seen.items()}


@pytest.mark.parametrize("listed, ways", [(4096, 4_000_000), (2, 4_000_000), (3, 25), (4096, 0)])
def test_reached_lists(spark, monkeypatch, listed, ways):
    """Lists in blocks, and roots with too many ways for a row, give what a search gives."""
    monkeypatch.setattr(graph, "LISTED", listed)
    monkeypatch.setattr(graph, "REACHED_WAYS", ways)
    draw = random.Random(5)
    pairs = {(f"n{draw.randrange(40)}", f"n{draw.randrange(40)}") for _ in range(45)} | {("hub", f"n{i}") for i in range(12)}
    roots = ["hub", "n1", "n7", "nowhere"]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in sorted(pairs)], "src string, dst string, weight double")
    got = graph.neighbourhood(spark.createDataFrame([(r,) for r in roots], "root string"), edges, 3).collect()
    expected = set().union(*(reached(r, pairs, 3) for r in roots))
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_lists_of_the_last_step_are_not_stored(spark, monkeypatch):
    names, keep = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, name: names.append(name) or keep(df, name))
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    got = {tuple(r) for r in graph.neighbourhood(spark.createDataFrame([("a",)], "root string"), edges, 2).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2)} and names.count("reached") == 2
