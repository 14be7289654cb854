"""Communities of a large, dense component: rounds that move many nodes at once."""

import random

from memspark.operators import communities
from memspark.plans import lift


def test_dense_component_takes_few_rounds(spark, monkeypatch):
    rnd = random.Random(2)
    edges = [(f"s{i:02d}", f"p{j:02d}", 5.0 if i % 4 == j % 4 else 1.0) for i in range(16) for j in range(64) if i % 4 == j % 4 or rnd.random() < 0.6]
    df = spark.createDataFrame(edges, "src string, dst string, weight double")
    nodes = spark.createDataFrame([(x,) for x in sorted({x for a, b, _ in edges for x in (a, b)})], "id string")
    rounds, keep = [], communities.stored
    monkeypatch.setattr(communities, "stored", lambda d, name: rounds.append(name) or keep(d, name))
    monkeypatch.setattr(communities, "BLOCK_EDGES", 400, raising=False)
    monkeypatch.setattr(communities, "MOST_ROUNDS", 20)
    first = {r.id: r.community for r in communities.louvain(nodes, df, most_edges=10).collect()}
    assert first == {x: f"p{int(x[1:]) % 4:02d}" for x in first}  # the planted groups, found within 20 rounds
    assert rounds.count("moves") <= 21


def test_lift_finds_communities_once_for_each_reflection(spark, monkeypatch):
    calls, keep = [], communities.louvain
    monkeypatch.setattr(communities, "louvain", lambda *a: calls.append(1) or keep(*a))
    nodes = spark.createDataFrame([("a", "a"), ("b", "b")], "id string, name string")
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    observed = spark.createDataFrame([(1, "a", "parser speed", "general", 0.9, 1.0)], "id int, entity_id string, content string, category string, confidence double, salience double")
    queries, records = spark.createDataFrame([("q", "parser")], "qid string, query string"), spark.createDataFrame([("1", "parser speed")], "id string, content string")
    lift.reflection_lift(nodes, edges, observed, queries, records, spark.createDataFrame([("q", "1", 1)], "qid string, id string, grade int"))
    assert len(calls) == 2
