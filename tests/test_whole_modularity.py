"""Modularity of all components, with all edges of their members."""

import pytest

from memspark.operators import graph


def test_modularity_of_components_without_edges_and_of_edges_that_leave_the_members(spark):
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", None)], "id string, component string")
    edges = spark.createDataFrame([("a", "b", 3.0), ("b", "c", 1.0), ("c", "elsewhere", 2.0)], "src string, dst string, weight double")
    got = {r.component: r.modularity for r in graph.modularity(members, edges).collect()}
    assert got == pytest.approx({"x": 6 / 12 - (7 / 12) ** 2, "y": -((3 / 12) ** 2), "z": 0.0, None: 0.0})
    none = graph.modularity(members, edges.limit(0))
    assert {r.component: r.modularity for r in none.collect()} == {"x": 0.0, "y": 0.0, "z": 0.0, None: 0.0}
