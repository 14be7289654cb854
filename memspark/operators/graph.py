"""Graph operators over edge tables (src, dst, weight)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators.stored import released, spread, stored

#: Edges (in both directions) of a component whose ranks one task finds, at most; and the queries of such a task, and its results.
RANKED_EDGES, RANKED_QUERIES, RANKED_ROWS = 2_000_000, 32, 4_000_000
#: Queries whose scores a task holds at once where components are larger; edges of a block of such a component, at most about and at least, and blocks of one that has as many.
BLOCK_QUERIES, BLOCK_EDGES, LEAST_EDGES, BLOCKS = 32, 4_000_000, 250_000, 16
#: Neighbours in a list, at most; ways from a root in a step whose lists meet in its row, at most; and ways that weigh as much as a row.
LISTED, REACHED_WAYS, WAYS_OF_ROW = 4096, 4_000_000, 32


def symmetric(edges: DataFrame) -> DataFrame:
    """src, dst, weight in both directions: parallel edges added, weights that are not above 0 as 1, loops left out."""
    w = F.when(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") <= 0), 1.0).otherwise(F.col("weight"))
    one = stored(edges.where("src <> dst").select("src", "dst", w.alias("weight")), "edges")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return spread(both, 2 * one.count(), "src", "dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, degree of every node: its edges, a loop once; nodes without edges have 0."""
    ends = edges.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def weighted_degrees(edges: DataFrame) -> DataFrame:
    return symmetric(edges).groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree"))


def neighbourhood(roots: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """root, id, distance of every node within ``depth`` steps of ``roots`` (root), edges taken both ways.

    Nodes have numbers, a node's neighbours are lists of them, and what a root has reached is two lists in its row: so lists move, not a row for each
    way. A root with more than REACHED_WAYS ways in a step goes by rows, which need no memory for a root.
    """
    both = stored(symmetric(edges).select("src", "dst"), "both")
    nodes = _numbered(both.select(F.col("src").alias("id")).distinct())
    code = lambda c: nodes.select(F.col("id").alias(c), F.col("code").alias(f"_{c}"))
    n = both.count()
    coded = spread(spread(both, n, "dst").join(code("dst"), "dst").select("src", "_dst"), n, "src").join(code("src"), "src").select("_src", "_dst")
    place = F.row_number().over(Window.partitionBy("_src").orderBy("_dst")) - 1
    near = coded.withColumn("_block", F.floor(place / LISTED)).groupBy("_src", "_block").agg(F.collect_list("_dst").alias("_near"))
    near = stored(near.select(F.col("_src").alias("_at"), "_near"), "near")
    degree = stored(near.groupBy("_at").agg(F.sum(F.size("_near")).alias("_degree")), "degree")

    none = F.array().cast(near.schema["_near"].dataType)
    state = roots.select("root").distinct().join(code("root"), "root").select("root", "_root", none.alias("_seen"), F.array("_root").alias("_new"))
    state = stored(state, "reached")
    found, large = [], state.select("root", "_root").limit(0)
    for step in range(1, depth + 1):
        edge = state.select("_root", F.explode("_new").alias("_at"))
        ways = stored(edge.join(degree, "_at").groupBy("_root").agg(F.sum("_degree").alias("_ways"), F.count("*").alias("_rows")), "ways")
        fits = F.col("_ways") <= REACHED_WAYS
        rows, listed = ways.where(fits).agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.sum("_ways"), F.lit(0))).first()
        rows = max(rows, listed // WAYS_OF_ROW)
        beyond = ways.where(~fits)
        if beyond.limit(1).count():
            large = large.unionByName(state.join(beyond, "_root", "left_semi").select("root", "_root"))
            state = state.join(beyond, "_root", "left_anti")
            edge = edge.join(beyond, "_root", "left_anti")
        lists = spread(spread(edge, rows, "_at").join(near, "_at").select("_root", "_near"), rows, "_root")
        lists = lists.groupBy("_root").agg(F.flatten(F.collect_list("_near")).alias("_near"))
        seen = F.concat("_seen", "_new")
        state = state.join(lists, "_root").select("root", "_root", seen.alias("_seen"), F.array_except("_near", seen).alias("_new"))
        state = state if step == depth else stored(state, "reached")  # the last step's lists are read once, by the rows of the result
        found.append(state.select("root", "_root", F.explode("_new").alias("code"), F.lit(step).alias("distance")))
    out = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("distance"))
    large = stored(large, "large")
    some = large.limit(1).count()
    for rows in found:
        rows = rows.join(large, "_root", "left_anti") if some else rows
        out = out.unionByName(rows.join(nodes, "code").select("root", "id", "distance"))
    return out.unionByName(_reached_by_rows(large.select("root"), both, depth)) if some else out


def _numbered(ids: DataFrame) -> DataFrame:
    """``ids`` (id, distinct) with a code: numbers from 0 without gaps, as int if they are few enough."""
    marked = stored(ids.select("id", F.monotonically_increasing_id().alias("_mark")), "marked")
    part, at = F.shiftright("_mark", 33), F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))
    starts = marked.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # one row for each partition
    starts = starts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    kind = "int" if marked.count() < 1 << 31 else "long"
    return stored(marked.withColumn("_part", part).join(F.broadcast(starts), "_part").select("id", (F.col("_start") + at).cast(kind).alias("code")), "numbered")


def _reached_by_rows(roots: DataFrame, both: DataFrame, depth: int) -> DataFrame:
    """root, id, distance from 1 on, a row for each node that a root reaches."""
    seen = edge = roots.select("root", F.col("root").alias("id"), F.lit(0).alias("distance"))
    for step in range(1, depth + 1):
        ways = edge.join(both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("_degree")), "id").agg(F.coalesce(F.sum("_degree"), F.lit(0))).first()[0]
        next_ = spread(edge.join(both, edge["id"] == both["src"]).select("root", F.col("dst").alias("id")), ways, "root", "id").distinct()
        edge = stored(next_.join(seen, ["root", "id"], "left_anti").withColumn("distance", F.lit(step)), "edge")
        seen = seen.unionByName(edge)
    return seen.where("distance > 0")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that a node reaches."""
    return _labelled(nodes, stored(symmetric(edges).select("src", "dst"), "both"))


def _labelled(nodes: DataFrame, both: DataFrame) -> DataFrame:
    """id, component of ``nodes`` (id) by the stored edges ``both`` (src, dst, in both directions).

    Nodes are numbered in an order of chance. In a round each joins its neighbour of the least number, and only the different edges between those that were
    joined are left: of a dense graph nearly none, of any other a share, so that rounds grow with the logarithm of the nodes.
    """
    linked = both.select(F.col("src").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi")
    numbers = stored(linked.orderBy(F.xxhash64("id"), "id").select("id", F.monotonically_increasing_id().alias("code")), "labels")
    number = lambda c, to: numbers.select(F.col("id").alias(c), F.col("code").alias(to))
    one = both.where("src < dst").select("src", "dst")
    n = both.count() // 2
    coded = spread(spread(one, n, "src").join(number("src", "a"), "src"), n, "dst").join(number("dst", "b"), "dst")
    pairs, rounds = stored(coded.select("a", "b"), "pairs"), []
    while n := pairs.count():
        ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stored(spread(ends, 2 * n, "a").groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")), "labels")
        rounds.append(near)
        to = lambda c: near.select(F.col("a").alias(c), F.col("to").alias(f"_{c}"))  # noqa: B023, E731
        moved = spread(spread(pairs, n, "a").join(to("a"), "a"), n, "b").join(to("b"), "b").where("_a <> _b")
        pairs = stored(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "pairs")
    labels = numbers.select("id", F.col("code").alias("to"))
    for near in rounds:
        labels = labels.join(near.select(F.col("a").alias("to"), F.col("to").alias("_to")), "to", "left").select("id", F.coalesce("_to", "to").alias("to"))
    labels = stored(labels, "labels")
    least = labels.groupBy("to").agg(F.min("id").alias("component"))
    return nodes.select("id").join(labels.join(least, "to").select("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def crossing(edges: DataFrame, members: DataFrame) -> DataFrame:
    """src, dst, score of ``edges`` (src, dst, weight, certain) between different communities of ``members`` (id, community, kind).

    The weight counts twice for crossing communities, half as much again if the ends are of different kinds, and half if the edge isn't certain.
    """
    end = lambda c: members.select(F.col("id").alias(c), F.col("community").alias(f"_{c}"), F.col("kind").alias(f"_kind_{c}"))
    both = edges.join(end("src"), "src").join(end("dst"), "dst").where("_src <> _dst")
    score = 2 * F.col("weight") * F.when(F.col("_kind_src") != F.col("_kind_dst"), 1.5).otherwise(1.0) * F.when(F.coalesce("certain", F.lit(False)), 1.0).otherwise(0.5)
    return both.select("src", "dst", F.round(score, 6).alias("score"))


def pagerank_push(seeds: DataFrame, edges: DataFrame, damping: float = 0.5, tolerance: float = 1e-6, most: int = 200) -> DataFrame:
    """qid, id, score of each query's ``seeds`` (qid, id, weight) by pushing residuals along: only nodes that mass comes to have rows.

    A node keeps 1 - damping of its residual and passes the rest on, while the residual is above ``tolerance`` for each of its edges. So
    a query touches 1 / ((1 - damping) * tolerance) edges at most, whatever the size of the graph, and no score is too low by more than the residuals that
    are left. Seeds outside the graph drop out; what a seed without edges would pass on returns to the seeds.
    """
    both = symmetric(edges)
    out = both.groupBy("src").agg(F.sum("weight").alias("_out"), F.count("*").alias("_degree"))
    steps = stored(both.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("_share")), "steps")
    degree = stored(out.select(F.col("src").alias("id"), "_degree"), "degree")
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = seeds.join(ids, "id", "left_semi").groupBy("qid", "id").agg(F.sum("weight").alias("weight"))
    whole = known.groupBy("qid").agg(F.sum("weight").alias("_all"))
    start = stored(known.join(whole, "qid").select("qid", "id", (F.col("weight") / F.col("_all")).alias("seed")), "start")
    state = start.join(degree, "id", "left").select("qid", "id", "_degree", F.lit(0.0).alias("score"), F.col("seed").alias("rest"))
    state = stored(state, "push")
    for _ in range(most):
        active = F.col("rest") > tolerance * F.coalesce("_degree", F.lit(1))
        if not state.where(active).limit(1).count():
            break
        moving = state.where(active)
        sent = moving.join(steps, moving["id"] == steps["src"]).select("qid", F.col("dst").alias("id"), (damping * F.col("rest") * F.col("_share")).alias("rest"))
        lost = moving.where("_degree IS NULL").groupBy("qid").agg((damping * F.sum("rest")).alias("_lost"))
        back = start.join(lost, "qid").select("qid", "id", (F.col("_lost") * F.col("seed")).alias("rest"))
        kept = state.select("qid", "id", F.when(active, F.col("score") + (1 - damping) * F.col("rest")).otherwise(F.col("score")).alias("score"), F.when(active, 0.0).otherwise(F.col("rest")).alias("rest"))
        comes = sent.unionByName(back).select("qid", "id", F.lit(0.0).alias("score"), "rest")
        sums = kept.unionByName(comes).groupBy("qid", "id").agg(F.sum("score").alias("score"), F.sum("rest").alias("rest"))
        state = stored(sums.join(degree, "id", "left").select("qid", "id", "_degree", "score", "rest"), "push")
    return state.select("qid", "id", "score", "rest")


def _back(lost: Column, damping: float, turn: int) -> Column:
    """What returns to a query's seeds in a round, if ``lost`` of their mass is at nodes without edges: these pass nothing on but to the seeds."""
    r = damping * lost
    return (1 - damping) * (1 - F.pow(r, F.lit(turn))) / (1 - r) + F.pow(r, F.lit(turn)) * (1 - damping + r)


def _ranked(edges: pa.Table, seeds: pa.Table, damping: float, most: int, tolerance: float) -> pa.Table:
    """qid, id, score of a component (src, dst, weight, in both directions) for the queries of ``seeds`` (qid, id, seed, lost)."""
    src, dst = edges["src"].combine_chunks(), edges["dst"].combine_chunks()
    ids = pc.unique(src)
    ids = ids.take(pc.sort_indices(ids))
    n, index = len(ids), lambda c: pc.index_in(c, value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
    a, b, w = index(src), index(dst), edges["weight"].to_numpy()
    order = np.lexsort((a, b))
    a, b, w = a[order], b[order], w[order]
    share = w / np.bincount(a, weights=w, minlength=n)[a]
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])  # every node has an edge to it
    queries = seeds["qid"].combine_chunks()
    names = pc.unique(queries)
    lane, at = pc.index_in(queries, value_set=names).to_numpy(zero_copy_only=False), index(seeds["id"].combine_chunks())
    given, lost = seeds["seed"].to_numpy(), seeds["lost"].to_numpy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for q in range(len(names)):
        mine = lane == q
        seed = np.bincount(at[mine], weights=given[mine], minlength=n)
        gone, x = float(lost[mine][0]), seed
        back, mass = 1 - damping + damping * gone, seed.sum()
        for _ in range(most):
            new = damping * np.add.reduceat(share * x[a], starts) + back * seed
            moved, x = np.abs(new - x).sum(), new
            back = 1 - damping + damping * gone * back
            if moved < tolerance * mass:
                break
        rows = np.flatnonzero(x)
        found.append((rows, x[rows]))
    lengths = [len(rows) for rows, _ in found]
    rows, scores = (np.concatenate([f[i] for f in found]) for i in range(2))
    return pa.Table.from_arrays([names.take(pa.array(np.repeat(np.arange(len(names)), lengths))), ids.take(pa.array(rows)), pa.array(scores)], names=["qid", "id", "score"])


def pagerank(seeds: DataFrame, edges: DataFrame, damping: float = 0.5, most: int = 50, tolerance: float = 1e-6, among: DataFrame | None = None) -> DataFrame:
    """qid, id, score: personalised PageRank of each query's ``seeds`` (qid, id, weight); with ``among`` (id), the rows of these nodes only.

    Seeds outside the graph drop out; mass at nodes without edges returns to the seeds. Stops when no query's scores move
    by ``tolerance`` in total, or after ``most`` rounds. Mass never leaves a connected component, so one of up to RANKED_EDGES edges is solved by a
    task for some of the queries that have seeds there; larger ones are solved in rounds over blocks of their edges.
    """
    edges = stored(edges.select("src", "dst", "weight"), "given")
    both = stored(symmetric(edges), "both")
    linked = stored(both.select(F.col("src").alias("id")).distinct(), "linked")
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    known = seeds.join(ids, "id", "left_semi").groupBy("qid", "id").agg(F.sum("weight").alias("weight"))
    whole = known.groupBy("qid").agg(F.sum("weight").alias("_all"))
    start = known.join(whole, "qid").select("qid", "id", (F.col("weight") / F.col("_all")).alias("seed"))
    start = start.join(linked.withColumn("_linked", F.lit(True)), "id", "left").withColumn("_linked", F.col("_linked").isNotNull())
    lost = F.coalesce(F.sum(F.when(~F.col("_linked"), F.col("seed"))).over(Window.partitionBy("qid")), F.lit(0.0))
    start = stored(start.withColumn("lost", lost), "start")
    alone = start.where("NOT _linked").select("qid", "id", (F.col("seed") * _back(F.col("lost"), damping, most - 1)).alias("score"))

    parts = stored(_labelled(linked, both), "components")
    placed = start.where("_linked").join(parts, "id")
    sizes = both.select(F.col("src").alias("id"), "weight").groupBy("id").agg(F.count("*").alias("_degree")).join(parts, "id")
    sizes = sizes.groupBy("component").agg(F.sum("_degree").alias("_edges"), F.count("*").alias("_nodes"))
    sizes = sizes.join(placed.groupBy("component").agg(F.countDistinct("qid").alias("_queries")), "component")
    each = F.least(F.lit(RANKED_QUERIES), F.greatest(F.lit(1), F.floor(F.lit(RANKED_ROWS) / F.col("_nodes"))))
    sizes = stored(sizes.select("component", "_edges", F.ceil(F.col("_queries") / each).cast("int").alias("_chunks")), "sizes")
    small = sizes.where(F.col("_edges") <= RANKED_EDGES)
    of = parts.join(small, "component").select(F.col("id").alias("src"), "component", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"))
    mine = both.join(of, "src").select("component", "chunk", "src", "dst", "weight")
    asked = placed.join(small, "component").select(F.col("component").alias("part"), F.pmod(F.xxhash64("qid"), F.col("_chunks")).cast("int").alias("lane"), "qid", "id", "seed", "lost")
    kind = {f.name: f.dataType.simpleString() for f in start.schema}

    def run(e: pa.Table, s: pa.Table) -> pa.Table:
        if not len(e) or not len(s):
            return pa.Table.from_arrays([s["qid"].slice(0, 0), s["id"].slice(0, 0), pa.array([], pa.float64())], names=["qid", "id", "score"])
        return _ranked(e, s, damping, most, tolerance)

    ranked = mine.groupBy("component", "chunk").cogroup(asked.groupBy("part", "lane")).applyInArrow(run, f"qid {kind['qid']}, id {kind['id']}, score double")
    out = ranked.unionByName(alone)
    giants = stored(sizes.where(F.col("_edges") > RANKED_EDGES).select("component"), "giants")
    if giants.limit(1).count():
        inside = parts.join(F.broadcast(giants), "component", "left_semi").select(F.col("id").alias("src"))  # all edges / RANKED_EDGES of them at most
        seeded = stored(placed.join(F.broadcast(giants), "component", "left_semi").select("qid", "id", "seed", "lost"), "placed")
        out = out.unionByName(_by_blocks(seeded, stored(both.join(inside, "src", "left_semi"), "giant_edges"), damping, most, tolerance, among))
    return out if among is None else out.join(among.select("id").distinct(), "id", "left_semi").select("qid", "id", "score")


#: What a row for a block holds; ``other`` is the block that it is from or for.
EDGES, OUT, SEEDS, ROUTE, STATE, VALUES, SUMS = range(7)
_ROWS = "block int, part int, kind int, other int, a binary, b binary, c binary"
_KEPT = "part int, lane int, code long, score double"


def _row(block: int, part: int, kind: int, other: int, *arrays: np.ndarray) -> tuple:
    return (block, part, kind, other, *[np.ascontiguousarray(x).tobytes() for x in arrays], *[None] * (3 - len(arrays)))


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 4 + [pa.binary()] * 3
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=["block", "part", "kind", "other", "a", "b", "c"])


def _block_of(blocks: int):
    def run(e: pa.Table) -> pa.Table:
        """A block's edges, by their low ends, and for each other block the places there of the nodes that they lead to."""
        low, high, w = (e[c].to_numpy() for c in ("low", "high", "weight"))
        order = np.lexsort((high, low))
        low, high, w = low[order], high[order], w[order]
        block, nodes = e["block"][0].as_py(), e["nodes"][0].as_py()
        mine = -(-(nodes - block) // blocks)
        away = np.unique(high[high % blocks != block])
        away = away[np.lexsort((away, away % blocks))]
        key = lambda x: (x % blocks) * (nodes // blocks + 1) + x // blocks
        at = np.where(high % blocks == block, high // blocks, mine + np.searchsorted(key(away), key(high)))
        small = bool(((w == np.floor(w)) & (w < 256)).all())
        rows = [_row(block, 0, EDGES, block, np.bincount(low // blocks, minlength=mine).astype(np.int32), at.astype(np.int32), w.astype(np.uint8) if small else w)]
        homes = away % blocks
        rows += [_row(int(h), 0, ROUTE, block, (away[homes == h] // blocks).astype(np.int32)) for h in np.unique(homes)]
        return _rows(rows)

    return run


def _summed(rows: pa.Table) -> pa.Table:
    """What comes to each node along a block's edges, sent to the nodes' blocks; ``rows`` are its edges, and VALUES from the blocks of their ends."""
    found = sorted(rows.to_pylist(), key=lambda r: (r["kind"], r["other"]))
    edges = [r for r in found if r["kind"] == EDGES]
    values = [r for r in found if r["kind"] == VALUES]
    if not edges or not values:
        return _rows([])
    block, part, counts, at = values[0]["block"], values[0]["part"], np.frombuffer(edges[0]["a"], np.int32), np.frombuffer(edges[0]["b"], np.int32)
    w = np.frombuffer(edges[0]["c"], np.uint8 if len(edges[0]["c"]) == len(at) else np.float64).astype(np.float64)
    values.sort(key=lambda r: (r["other"] != block, r["other"]))
    mine = len(counts)
    lanes = len(values[0]["a"]) // 8 // mine
    x = np.concatenate([np.frombuffer(r["a"], np.float64).reshape(lanes, -1) for r in values], axis=1)
    cuts = np.cumsum([0, *[len(r["a"]) // 8 // lanes for r in values]])
    y, full = np.zeros(x.shape), np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    for i in range(lanes):
        y[i] = np.bincount(at, np.repeat(x[i, :mine], counts) * w, x.shape[1])
        y[i, full] += np.add.reduceat(x[i, at] * w, starts) if len(full) else 0.0
    return _rows([_row(r["other"], part, SUMS, block, y[:, a:b]) for r, a, b in zip(values, cuts[:-1], cuts[1:], strict=True)])


def _scored(damping: float, turn: int):
    def run(rows: pa.Table) -> pa.Table:
        """A block's scores after a round (STATE, with what they moved by), and what its nodes pass on to the blocks that have edges of theirs (VALUES)."""
        found = sorted(rows.to_pylist(), key=lambda r: (r["kind"], r["other"]))
        of = {k: [r for r in found if r["kind"] == k] for k in (OUT, SEEDS, ROUTE, STATE, SUMS)}
        if not of[OUT]:
            return _rows([])
        block, part, lanes = found[0]["block"], found[0]["part"], of[OUT][0]["other"]
        out = np.frombuffer(of[OUT][0]["a"], np.float64)
        routes = {r["other"]: np.frombuffer(r["a"], np.int32) for r in of[ROUTE]}
        new = np.zeros((lanes, len(out)))
        for r in of[SUMS]:
            new[:, slice(None) if r["other"] == block else routes[r["other"]]] += np.frombuffer(r["a"], np.float64).reshape(lanes, -1)
        new *= damping
        for r in of[SEEDS]:
            (place, lane), (seed, lost) = np.frombuffer(r["a"], np.int64).reshape(2, -1), np.frombuffer(r["b"], np.float64).reshape(2, -1)
            gone = damping * lost
            back = 1.0 if turn < 0 else (1 - damping) * (1 - gone**turn) / (1 - gone) + gone**turn * (1 - damping + gone)
            new[lane, place] += back * seed
        was = np.frombuffer(of[STATE][0]["a"], np.float64).reshape(new.shape) if of[STATE] else 0.0
        passed = new / out
        given = [_row(block, part, VALUES, block, passed), *[_row(k, part, VALUES, block, passed[:, places]) for k, places in routes.items()]]
        return _rows([_row(block, part, STATE, block, new, np.abs(new - was).sum(axis=1)), *given])

    return run


def _unpacked(blocks: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                places = np.frombuffer(r["places"], np.int64)
                x = np.frombuffer(r["a"], np.float64).reshape(len(r["b"]) // 8, -1)[:, places]
                for lane in range(len(x)):
                    some = np.flatnonzero(x[lane])
                    numbers = [pa.array(np.full(len(some), v), pa.int32()) for v in (r["part"], lane)]
                    yield pa.RecordBatch.from_arrays([*numbers, pa.array(places[some] * blocks + r["block"]), pa.array(x[lane, some])], names=["part", "lane", "code", "score"])

    return run


def _gaps(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["part"], pa.array([np.frombuffer(b, np.float64).tolist() for b in batch["b"].to_pylist()], pa.list_(pa.float64()))], names=["part", "moved"])


def _by_blocks(start: DataFrame, both: DataFrame, damping: float, most: int, tolerance: float, among: DataFrame | None = None) -> DataFrame:
    """qid, id, score for ``start`` (qid, id, seed, lost) over ``both`` (src, dst, weight, in both directions), of nodes ``among`` (id) if given.

    Nodes are dealt to blocks, and an edge is in the block of the end that has fewer edges. In a round a block adds up what comes along its edges to its own nodes
    and to those of other blocks, and sends these sums there; scores are arrays, so what moves is one number for each query and each node that
    a block shares with another, not a row for each edge. The tables of a round are deleted after the next one.
    """
    n = both.count() // 2
    out = both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("_out"), F.count("*").alias("_degree"))
    nodes = _numbered(out.select("id")).join(out, "id").select("id", F.col("code").cast("long").alias("code"), "_out", "_degree")
    nodes = stored(nodes, "nodes")
    count = nodes.count()
    blocks = min(count, max(1, min(BLOCKS, -(-n // LEAST_EDGES)), -(-n // BLOCK_EDGES)))
    end = lambda c: nodes.select(F.col("id").alias(c), F.struct("_degree", "code").alias(f"_{c}"))
    named = spread(spread(both.where("src < dst"), n, "src").join(end("src"), "src"), n, "dst").join(end("dst"), "dst")
    ends = named.select(F.least("_src", "_dst")["code"].alias("low"), F.greatest("_src", "_dst")["code"].alias("high"), "weight", F.lit(count).cast("long").alias("nodes"))
    fixed = stored(ends.withColumn("block", (F.col("low") % blocks).cast("int")).groupBy("block").applyInArrow(_block_of(blocks), _ROWS), "block_edges")

    deal = F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-start.select("qid").distinct().count() // BLOCK_QUERIES))))
    queries = start.select("qid").distinct().withColumn("_deal", deal).withColumn("_n", F.row_number().over(Window.partitionBy("_deal").orderBy("qid")) - 1)
    queries = queries.select("qid", "_deal", F.floor(F.col("_n") / BLOCK_QUERIES).alias("_chunk"), (F.col("_n") % BLOCK_QUERIES).cast("int").alias("lane"))
    queries = stored(queries, "dealt")
    parts = queries.groupBy("_deal", "_chunk").agg(F.count("*").cast("int").alias("_lanes"))  # a row for BLOCK_QUERIES queries
    parts = stored(parts.withColumn("part", F.row_number().over(Window.orderBy("_deal", "_chunk")).cast("int")), "parts")
    lanes = queries.join(F.broadcast(parts), ["_deal", "_chunk"]).select("qid", "part", "lane")

    block, place = (F.col("code") % blocks).cast("int"), F.floor(F.col("code") / blocks).cast("long")
    outs = spread(nodes.select(block.alias("block"), place.alias("place"), "_out"), count, "block").groupBy("block")

    def packed(t: pa.Table) -> pa.Table:
        return _rows([_row(t["block"][0].as_py(), 0, OUT, 0, t["_out"].to_numpy()[np.argsort(t["place"].to_numpy())])])

    def sown(t: pa.Table) -> pa.Table:
        order = np.lexsort((t["place"].to_numpy(), t["lane"].to_numpy()))
        column = lambda c: t[c].to_numpy()[order]
        key = t["block"][0].as_py(), t["part"][0].as_py()
        return _rows([_row(*key, SEEDS, 0, np.stack([column("place"), column("lane")]).astype(np.int64), np.stack([column("seed"), column("lost")]))])

    each = F.broadcast(parts.select(F.col("part").alias("_part"), "_lanes"))
    for_parts = lambda rows: rows.crossJoin(each).withColumn("part", F.col("_part")).withColumn("other", F.when(F.col("kind") == OUT, F.col("_lanes")).otherwise(F.col("other"))).drop("_part", "_lanes")
    seeds = start.join(nodes.select("id", "code"), "id").join(lanes, "qid").select(block.alias("block"), "part", place.alias("place"), "lane", "seed", "lost")
    homes = stored(outs.applyInArrow(packed, _ROWS), "block_nodes")
    seeds = stored(seeds.groupBy("block", "part").applyInArrow(sown, _ROWS), "giant_start")
    given = for_parts(homes).unionByName(for_parts(fixed.where(f"kind = {ROUTE}"))).unionByName(seeds)
    sources = for_parts(fixed.where(f"kind = {EDGES}"))
    wide = blocks * parts.count()
    by_block = lambda rows: rows.repartition(wide, "block", "part").groupBy("block", "part")

    scores, gone = stored(by_block(given).applyInArrow(_scored(damping, -1), _ROWS), "scores"), []
    for turn in range(most):
        sums = by_block(sources.unionByName(scores.where(f"kind = {VALUES}"))).applyInArrow(_summed, _ROWS)
        new = stored(by_block(given.unionByName(scores.where(f"kind = {STATE}")).unionByName(sums)).applyInArrow(_scored(damping, turn), _ROWS), "scores")
        released(scores)
        scores = new
        moved = scores.where(f"kind = {STATE}").select("part", "b").mapInArrow(_gaps, "part int, moved array<double>")
        gap = moved.select("part", F.posexplode("moved")).groupBy("part", "pos").agg(F.sum("col").alias("_gap")).agg(F.max("_gap")).first()[0]
        if gap is None or gap < tolerance:
            break
    kept = nodes if among is None else nodes.join(among.select("id").distinct(), "id", "left_semi")

    def places(t: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([t["block"].slice(0, 1), pa.array([np.sort(t["place"].to_numpy()).tobytes()], pa.binary())], names=["block", "places"])

    kept = kept.select(block.alias("block"), place.alias("place")).groupBy("block").applyInArrow(places, "block int, places binary")
    found = scores.where(f"kind = {STATE}").join(kept, "block").select("block", "part", "a", "b", "places").mapInArrow(_unpacked(blocks), _KEPT)
    return found.join(lanes, ["part", "lane"]).join(nodes.select("id", "code"), "code").select("qid", "id", "score")


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """component, modularity for all ``members`` (id, component): inner weight over all weight less the square of the degree share.

    An edge of a member counts for its component whether its other end has one or not; components without edges, and all of a graph without any, have 0.
    """
    both = stored(symmetric(edges), "both")
    n = both.count()
    all_ = both.agg(F.sum("weight").alias("_2m"))
    a, b = members.withColumnsRenamed({"id": "src", "component": "_a"}), members.withColumnsRenamed({"id": "dst", "component": "_b"})
    named = spread(spread(both, n, "dst").join(b, "dst", "left"), n, "src").join(a, "src", "right")
    inner = F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)
    sums = named.groupBy(F.col("_a").alias("component")).agg(F.sum(inner).alias("_in"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_tot"))
    found = F.col("_in") / F.col("_2m") - F.pow(F.col("_tot") / F.col("_2m"), 2)
    return sums.crossJoin(F.broadcast(all_)).select("component", F.coalesce(found, F.lit(0.0)).alias("modularity"))


def containment(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, name, path) for every prefix of ``paths`` (path), and their part_of edges (src, dst)."""
    from memspark.functions.text import scope_chain, slugify

    prefixes = paths.select(F.explode(F.filter(scope_chain(F.col("path")), lambda p: p != "")).alias("path")).distinct()
    id_ = lambda p: F.concat(slugify(p), F.lit("-"), F.substring(F.sha2(p, 256), 1, 10))
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    named = prefixes.select(id_(F.col("path")).alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", parent.alias("_parent"))
    edges = named.where("_parent <> ''").select(F.col("id").alias("src"), id_(F.col("_parent")).alias("dst")).where("src <> dst").distinct()
    return named.drop("_parent"), edges


def related(edges: DataFrame, k: int = 12) -> DataFrame:
    """id, other, reverse, rank: at most ``k`` edges of each node, heaviest first, incoming ones as reverse."""
    edges = stored(edges.select("src", "dst", "weight"), "edges")
    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit(False).alias("reverse"), "weight")
    both = out.unionByName(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit(True).alias("reverse"), "weight"))
    both = spread(both, 2 * edges.count(), "id")
    w = Window.partitionBy("id").orderBy(F.col("weight").desc(), "other", "reverse")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
