"""Graph queries over the supplier-part graph and the containment of page paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from memspark.operators import graph
from memspark.operators.search import top
from memspark.plans import mapping
from memspark.tables import table

C = F.col


def god_nodes(spark, sf_dir):
    found = graph.degrees(mapping.entities(spark, sf_dir), mapping.relations(spark, sf_dir)).where("degree > 0")
    return found.orderBy(C("degree").desc(), "id").limit(10)


def orphans(spark, sf_dir):
    found = graph.degrees(mapping.entities(spark, sf_dir), mapping.relations(spark, sf_dir)).where("degree <= 1")
    return found.orderBy("degree", "id").limit(20)


def all_degrees(spark, sf_dir):
    return graph.degrees(mapping.entities(spark, sf_dir), mapping.relations(spark, sf_dir))


def weighted(spark, sf_dir):
    return graph.weighted_degrees(mapping.relations(spark, sf_dir))


def scoped(spark, sf_dir):
    """Edges whose two ends lie in a scope."""
    e = mapping.entities(spark, sf_dir).select("id", "scope")
    r = mapping.relations(spark, sf_dir)
    r = r.join(e.withColumnsRenamed({"id": "src", "scope": "src_scope"}), "src").join(e.withColumnsRenamed({"id": "dst", "scope": "dst_scope"}), "dst")
    return r.where(C("src_scope").isin("nation/3", "nation/7", "parts") & C("dst_scope").isin("nation/3", "nation/7", "parts")).select("src", "dst", "weight")


def hops(spark, sf_dir):
    """Two steps around the suppliers of all nations, over edges with weight > 1."""
    roots = mapping.entities(spark, sf_dir).where("entity_type = 'supplier'").select(C("id").alias("root"))
    return graph.neighbourhood(roots, mapping.relations(spark, sf_dir).where("weight > 1"), 2)


def components(spark, sf_dir):
    return graph.components(mapping.entities(spark, sf_dir), mapping.relations(spark, sf_dir))


def ranks(spark, sf_dir):
    """The suppliers of each nation as a seed set, for three rounds."""
    seeds = mapping.entities(spark, sf_dir).where("entity_type = 'supplier'").select(C("scope").alias("qid"), "id", F.lit(1.0).alias("weight"))
    return graph.pagerank(seeds, mapping.relations(spark, sf_dir), most=3, tolerance=0.0).select("qid", "id", F.round("score", 8).alias("score"))


def nation_hops(spark, sf_dir):
    """Two steps around the suppliers of all nations, over all edges."""
    roots = mapping.entities(spark, sf_dir).where("entity_type = 'supplier'").select(C("id").alias("root"))
    return graph.neighbourhood(roots, mapping.relations(spark, sf_dir), 2)


def nation_ranks(spark, sf_dir):
    """The suppliers of each nation as a seed set, until scores settle."""
    seeds = mapping.entities(spark, sf_dir).where("entity_type = 'supplier'").select(C("scope").alias("qid"), "id", F.lit(1.0).alias("weight"))
    return graph.pagerank(seeds, mapping.relations(spark, sf_dir)).select("qid", "id", F.round("score", 8).alias("score"))


def parts_modularity(spark, sf_dir):
    members = mapping.entities(spark, sf_dir).select("id", C("scope").alias("component"))
    return graph.modularity(members, mapping.relations(spark, sf_dir)).select("component", F.round("modularity", 9).alias("modularity"))


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))


def contained(spark, sf_dir):
    return graph.containment(_paths(spark, sf_dir))[0]


def contained_edges(spark, sf_dir):
    return graph.containment(_paths(spark, sf_dir))[1]


def related(spark, sf_dir):
    return graph.related(mapping.relations(spark, sf_dir))


QUERIES = {
    "a2_god_nodes": god_nodes, "a3_orphans": orphans, "j3_degrees": all_degrees, "g6_weighted_degree": weighted, "g3_scope_subgraph": scoped, "g1_neighbourhood": hops,
    "g1_neighbourhood_all": nation_hops, "g2_pagerank_all": nation_ranks,
    "g7_components": components, "g2_pagerank": ranks, "g5_modularity": parts_modularity, "g10_containment": contained, "g10_containment_edges": contained_edges, "g11_related": related,
}
_WITH = f"WITH RECURSIVE {mapping.ENTITIES_SQL}, {mapping.RELATIONS_SQL}, both_ AS (SELECT src, dst, weight FROM relations UNION ALL SELECT dst, src, weight FROM relations)"
_DEGREES = f"{_WITH}, d AS (SELECT id, count(src) AS degree FROM entities LEFT JOIN both_ ON id = src GROUP BY id)"
_STEP = """{n} AS MATERIALIZED (SELECT qid, id, sum(x) AS score FROM (
  SELECT qid, b.dst AS id, 0.5 * {p}.score * b.weight / o.t AS x FROM {p} JOIN both_ b ON {p}.id = b.src JOIN outs o ON o.src = b.src UNION ALL SELECT qid, id, 0.5 * score FROM s0) GROUP BY qid, id)"""
# labels spread by a step; ten steps reach all of a graph of suppliers that share parts
_SPREAD = """{n} AS MATERIALIZED (SELECT id, min(c) AS c FROM (SELECT id, c FROM {p} UNION ALL SELECT b.dst, c FROM {p} JOIN both_ b ON b.src = id) GROUP BY id)"""
COMPONENTS_SQL = f"{_WITH}, l0 AS (SELECT id, id AS c FROM entities), {', '.join(_SPREAD.format(n=f'l{i + 1}', p=f'l{i}') for i in range(10))}"
ORACLE_SQL = {
    "a2_god_nodes": f"{_DEGREES} SELECT * FROM d WHERE degree > 0 ORDER BY degree DESC, id LIMIT 10",
    "a3_orphans": f"{_DEGREES} SELECT * FROM d WHERE degree <= 1 ORDER BY degree, id LIMIT 20",
    "j3_degrees": f"{_DEGREES} SELECT * FROM d",
    "g6_weighted_degree": f"{_WITH} SELECT src AS id, sum(weight) AS degree FROM both_ GROUP BY src",
    "g3_scope_subgraph": f"{_WITH} SELECT src, dst, weight FROM relations r JOIN entities a ON a.id = src JOIN entities b ON b.id = dst WHERE a.scope IN ('nation/3', 'nation/7', 'parts') AND b.scope IN ('nation/3', 'nation/7', 'parts')",
    "g1_neighbourhood": f"""{_WITH}, h AS (SELECT * FROM both_ WHERE weight > 1), z AS (SELECT id AS root, id, 0 AS distance FROM entities WHERE entity_type = 'supplier'),
      o AS (SELECT DISTINCT root, dst AS id FROM z JOIN h ON id = src), t AS (SELECT DISTINCT root, dst AS id FROM o JOIN h ON id = src)
      SELECT root, id, min(distance) AS distance FROM (SELECT * FROM z UNION ALL SELECT *, 1 FROM o UNION ALL SELECT *, 2 FROM t) GROUP BY root, id""",
    "g1_neighbourhood_all": f"""{_WITH}, z AS (SELECT id AS root, id, 0 AS distance FROM entities WHERE entity_type = 'supplier'),
      o AS (SELECT DISTINCT root, dst AS id FROM z JOIN both_ ON id = src), t AS (SELECT DISTINCT root, dst AS id FROM o JOIN both_ ON id = src)
      SELECT root, id, min(distance) AS distance FROM (SELECT * FROM z UNION ALL SELECT *, 1 FROM o UNION ALL SELECT *, 2 FROM t) GROUP BY root, id""",
    "g7_components": f"{COMPONENTS_SQL} SELECT id, c AS component FROM l10",
    "g2_pagerank": f"""{_WITH}, outs AS (SELECT src, sum(weight) AS t FROM both_ GROUP BY src), k AS (SELECT scope AS qid, id FROM entities WHERE entity_type = 'supplier' AND id IN (SELECT src FROM both_)),
      s0 AS (SELECT qid, id, 1.0 / count(*) OVER (PARTITION BY qid) AS score FROM k), {_STEP.format(n='s1', p='s0')}, {_STEP.format(n='s2', p='s1')}, {_STEP.format(n='s3', p='s2')} SELECT qid, id, round(score, 8) AS score FROM s3""",
    "g5_modularity": f"""{_WITH}, x AS (SELECT a.scope AS component, sum(CASE WHEN a.scope = b.scope THEN weight ELSE 0 END) AS i, coalesce(sum(weight), 0) AS t FROM entities a LEFT JOIN both_ ON a.id = src LEFT JOIN entities b ON b.id = dst GROUP BY 1)
      SELECT component, coalesce(round(i / (SELECT sum(weight) FROM both_) - (t / (SELECT sum(weight) FROM both_)) ** 2, 9), 0) AS modularity FROM x""",
    "g11_related": f"""{_WITH}, e AS (SELECT src AS id, dst AS other, false AS reverse, weight FROM relations UNION ALL SELECT dst, src, true, weight FROM relations)
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, other, reverse) AS rank FROM e QUALIFY rank <= 12""",
}
_PREFIXES = """WITH p AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS path FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS s FROM pages)) WHERE array_to_string(s[1:i], '/') <> ''),
  n AS (SELECT path, regexp_replace(path, '/?[^/]*$', '') AS parent, string_split(path, '/')[-1] AS name FROM p)"""
_ID = "regexp_replace(regexp_replace(lower(trim({p})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || sha256({p})[1:10]"
ORACLE_SQL["g10_containment"] = f"{_PREFIXES} SELECT {_ID.format(p='path')} AS id, name, path FROM n"
ORACLE_SQL["g10_containment_edges"] = f"{_PREFIXES} SELECT DISTINCT {_ID.format(p='path')} AS src, {_ID.format(p='parent')} AS dst FROM n WHERE parent <> ''"
