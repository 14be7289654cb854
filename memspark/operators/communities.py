"""Communities of a graph, their summaries, and the reflection job that proposes them as candidates."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators import graph
from memspark.operators.listing import keywords
from memspark.operators.search import top
from memspark.operators.stored import released, spread, stored

LEAST_GAIN, MOST_SWEEPS = 1e-12, 100
#: Edges (in both directions) of a component that one task sweeps, at most; larger ones move in rounds over all tasks.
MOST_EDGES = 4_000_000
#: Rounds of parallel moves at most; the share of movers below which, and rounds without this much more modularity after which, they end.
MOST_ROUNDS, LEAST_SHARE, CALM_ROUNDS, LEAST_RISE = 200, 1 / 64, 3, 1e-6
#: Edges of a block of such a round, about; the turns that its nodes move in; the share of movers at first, and how it grows with each round that isn't taken back.
BLOCK_EDGES, BATCHES, FIRST_SHARE, SHARE_GROWTH = 500_000, 64, 0.5, 1.05
# The order of observation categories in a summary; any other comes last.
CATEGORY_ORDER = "decision architecture risk pattern convention gotcha learned dependency blocker preference progress general".split()
LABEL_CHARACTERS, KEYWORDS, OBSERVATIONS = 80, 12, 8


def _moved(near: list[list[int]], weights: list[list[float]], whole: float) -> list[int]:
    """A community for each node by local moving: in id order, each node goes where modularity gains most, ties to the lowest community."""
    degree = [sum(w) for w in weights]
    own, total, square = list(range(len(near))), list(degree), whole**2
    for _ in range(MOST_SWEEPS):
        still = True
        for i, nodes in enumerate(near):
            into: dict[int, float] = {}
            for j, w in zip(nodes, weights[i], strict=True):
                c = own[j]
                into[c] = into.get(c, 0.0) + w
            mine, d = own[i], degree[i]
            total[mine] -= d
            best, most = mine, 2 * into.get(mine, 0.0) / whole - 2 * total[mine] * d / square
            # what doesn't gain more than staying doesn't gain more than any later choice
            least = most + LEAST_GAIN
            gains = [(c, gain) for c, k in into.items() if (gain := 2 * k / whole - 2 * total[c] * d / square) > least]
            for c, gain in sorted(gains):
                if gain > most + LEAST_GAIN:
                    best, most = c, gain
            total[best] += d
            if best != mine:
                own[i], still = best, False
        if still:
            break
    return own


def _best_moves(src: np.ndarray, dst: np.ndarray, w: np.ndarray, own: np.ndarray, degree: np.ndarray, total: np.ndarray, whole: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes of ``src`` that would move, where modularity gains most, ties to the lowest community; the weight that stays inside for each entry of ``own``)."""
    inside = np.zeros(len(own))
    if not len(src):
        return src, src, inside
    key = src * len(total) + own[dst]
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    k, node, community = np.add.reduceat(w[order], starts), key[starts] // len(total), key[starts] % len(total)
    first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    nodes = node[first]
    at, same = np.repeat(np.arange(len(nodes)), np.diff(np.r_[first, len(node)])), community == own[node]
    gain = k - (total[community] - same * degree[node]) * degree[node] / whole
    stay = -(total[own[nodes]] - degree[nodes]) * degree[nodes] / whole
    stay[at[same]] = gain[same]
    inside[node[same]] = k[same]
    best = np.maximum.reduceat(gain, first)
    hit = np.flatnonzero(gain == best[at])
    to = community[hit[np.r_[True, at[hit][1:] != at[hit][:-1]]]]
    moves = 2 / whole * (best - stay) > LEAST_GAIN
    return nodes[moves], to[moves], inside


#: What a row for a block holds; ``other`` is the block that it is from or for.
EDGES, VIEW, ROUTE, VALUES = range(4)
_ROWS = "block int, kind int, other int, a binary, b binary, c binary"
_MOVED = "block int, id long, community long, degree double, inside double, wants boolean"


def _row(block: int, kind: int, other: int, *arrays: np.ndarray) -> tuple:
    return (block, kind, other, *[np.ascontiguousarray(x).tobytes() for x in arrays], *[None] * (3 - len(arrays)))


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = [pa.int32()] * 3 + [pa.binary()] * 3
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=["block", "kind", "other", "a", "b", "c"])


def _block_of(e: pa.Table) -> pa.Table:
    """A block's edges and the nodes in its view, its own and their neighbours; and for each block the nodes of it that are seen here."""
    block = e["block"][0].as_py()
    src, dst, home, w, degree = (e[c].to_numpy() for c in ("src", "dst", "home", "weight", "degree"))
    order = np.lexsort((dst, src))  # whatever order the shuffle gives, sums are the same in each run
    src, dst, home, w, degree = src[order], dst[order], home[order], w[order], degree[order]
    ids = np.unique(np.concatenate([src, dst]))
    homes, degrees = np.full(len(ids), block, np.int32), np.zeros(len(ids))
    a, b = np.searchsorted(ids, src), np.searchsorted(ids, dst)
    homes[b], degrees[a] = home, degree
    small = bool(((w == np.floor(w)) & (w < 256)).all())
    counts = np.bincount(a, minlength=len(ids))
    rows = [_row(block, EDGES, block, counts.astype(np.int32), b.astype(np.int32), w.astype(np.uint8) if small else w), _row(block, VIEW, block, ids, homes, degrees)]
    return _rows(rows + [_row(int(h), ROUTE, block, ids[homes == h]) for h in np.unique(homes)])


def _passed(now: pa.Table, routes: pa.Table) -> pa.Table:
    """The communities of a block's nodes and their totals, for each block that sees some of them."""
    if not len(now):
        return _rows([])
    column = lambda c: now[c].to_numpy()
    order = np.argsort(column("id"))
    ids, community, total, block = column("id")[order], column("community")[order], column("total")[order], now["block"][0].as_py()
    at = lambda r: np.searchsorted(ids, np.frombuffer(r["a"], np.int64))
    return _rows([_row(r["other"], VALUES, block, community[i], total[i]) for r in routes.to_pylist() for i in [at(r)]])


def _block_moved(rows: pa.Table, whole: float, share: float, turn: int) -> pa.Table:
    """id, community, degree, inside, wants of a block's own nodes after a round; ``rows`` are its edges, its view and the values of the nodes there.

    ``inside`` (the weight to the node's own community) and ``wants`` (whether it would move) are those before the round. The nodes that may move
    go in BATCHES turns in id order, and each turn sees those before it; other blocks' nodes stay where they were.
    """
    found = rows.to_pylist()
    of = {k: [r for r in found if r["kind"] == k] for k in (EDGES, VIEW, VALUES)}
    (edges,), (view,) = of[EDGES], of[VIEW]
    block, ids, homes, degree = view["block"], *(np.frombuffer(view[c], t) for c, t in (("a", np.int64), ("b", np.int32), ("c", np.float64)))
    counts, dst = np.frombuffer(edges["a"], np.int32), np.frombuffer(edges["b"], np.int32).astype(np.int64)
    src, w = np.repeat(np.arange(len(ids)), counts), np.frombuffer(edges["c"], np.uint8 if len(edges["c"]) == len(dst) else np.float64).astype(np.float64)
    community, of_node, mine = np.zeros(len(ids), np.int64), np.zeros(len(ids)), homes == block
    for r in of[VALUES]:
        there = homes == r["other"]
        community[there], of_node[there] = np.frombuffer(r["a"], np.int64), np.frombuffer(r["b"], np.float64)
    named, own = np.unique(community, return_inverse=True)
    total = np.zeros(len(named))
    total[own] = of_node
    wants = np.zeros(len(ids), bool)
    movers, _, inside = _best_moves(src, dst, w, own, degree, total, whole)
    wants[movers] = True
    free = np.flatnonzero(mine & (np.random.default_rng([turn, block]).random(len(ids)) < share))
    batch = np.full(len(ids), BATCHES)
    batch[free] = np.arange(len(free)) * BATCHES // max(1, len(free))
    order = np.argsort(batch[src], kind="stable")
    src, dst, w = src[order], dst[order], w[order]
    cuts = np.searchsorted(batch[src], np.arange(BATCHES + 1))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        movers, to, _ = _best_moves(src[lo:hi], dst[lo:hi], w[lo:hi], own, degree, total, whole)
        np.add.at(total, to, degree[movers])
        np.add.at(total, own[movers], -degree[movers])
        own[movers] = to
    names = ["block", "id", "community", "degree", "inside", "wants"]
    return pa.Table.from_arrays([pa.array(x) for x in (homes[mine], ids[mine], named[own[mine]], degree[mine], inside[mine], wants[mine])], names=names)


def _by_rounds(both: DataFrame, whole: float) -> DataFrame:
    """id, community of the nodes of ``both`` (src, dst, weight, in both directions) by rounds of parallel moves.

    Nodes are dealt into blocks of about BLOCK_EDGES edges. In a round a task moves a share of a block's nodes, each to where modularity gains most by
    what it sees: the moves of its own block, and other blocks as they were. A round after which modularity is lower is taken back, and fewer may
    move. No task holds more than a block, with the communities of the nodes that its edges lead to. A block's edges and the nodes that it sees of each other
    block are arrays, so a round moves those, and two numbers for each node that a block sees. Tables of a round are deleted when they aren't needed.
    """
    degrees = stored(both.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("degree")), "degrees")
    n = both.count()
    blocks = -(-n // BLOCK_EDGES)
    # numbers in the order of ids
    numbers = stored(degrees.orderBy("id").select("id", F.monotonically_increasing_id().alias("number"), "degree"), "numbers")
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = numbers.select(F.col("id").alias("src"), F.col("number").alias("_src"), block.alias("block"), "degree")
    edges = spread(both, n, "src").join(dealt, "src")
    edges = spread(edges, n, "dst").join(numbers.select(F.col("id").alias("dst"), F.col("number").alias("_dst"), block.alias("home")), "dst")
    edges = edges.select("block", F.col("_src").alias("src"), F.col("_dst").alias("dst"), "home", "weight", "degree")
    fixed = stored(edges.repartition(2 * blocks, "block").groupBy("block").applyInArrow(_block_of, _ROWS), "block_edges")
    routes, fixed = fixed.where(f"kind = {ROUTE}").select("block", "other", "a"), fixed.where(f"kind <> {ROUTE}")
    now = stored(numbers.select(block.alias("block"), F.col("number").alias("id"), F.col("number").alias("community"), "degree"), "moves")

    def of_round(share: float, turn: int) -> Callable[[pa.Table], pa.Table]:
        def run(rows: pa.Table) -> pa.Table:
            return _block_moved(rows, whole, share, turn)

        return run

    before, highest, share, calm = None, None, FIRST_SHARE if blocks > 1 else 1.0, 0  # the turns of a single block see all moves
    for turn in range(MOST_ROUNDS):
        totals = stored(now.groupBy("community").agg(F.sum("degree").alias("total")), "totals")
        known = now.select("block", "id", "community").join(totals, "community").repartition(2 * blocks, "block")
        values = known.groupBy("block").cogroup(routes.repartition(2 * blocks, "block").groupBy("block")).applyInArrow(_passed, _ROWS)
        moved = stored(fixed.unionByName(values).repartition(2 * blocks, "block").groupBy("block").applyInArrow(of_round(share, turn), _MOVED), "moves")
        sums = moved.agg(F.sum("inside").alias("inside"), F.count_if("wants").alias("wanting"))
        inside, wanting, squares = sums.crossJoin(totals.agg(F.sum(F.col("total") * F.col("total")))).first()
        released(totals)
        modularity = inside / whole - squares / whole**2
        if highest is not None and modularity < highest:
            released(moved)
            released(now)
            now, share = before, share / 2
            if share < LEAST_SHARE:
                break
            highest = None  # the same state in another order, with fewer movers
            continue
        calm = calm + 1 if highest is not None and modularity - highest < LEAST_RISE else 0
        if calm >= CALM_ROUNDS or not wanting:
            break
        if before is not None and before is not now:
            released(before)
        before, now, highest, share = now, moved, modularity, min(1.0, SHARE_GROWTH * share)
    lowest = now.groupBy("community").agg(F.min("id").alias("lowest"))
    first = numbers.select(F.col("number").alias("lowest"), F.col("id").alias("_lowest"))
    found = now.select(F.col("id").alias("number"), "community").join(lowest, "community").join(first, "lowest")
    return found.join(numbers.select("id", "number"), "number").select("id", F.col("_lowest").alias("community"))


def louvain(nodes: DataFrame, edges: DataFrame, most_edges: int = MOST_EDGES) -> DataFrame:
    """id, community (the lowest id of its members) by single-level modularity moves, each connected component by itself.

    Gains couple components through the total weight only, so components are independent groups. One of up to ``most_edges`` edges is swept in
    id order by a task; a larger one moves in rounds over all tasks, to communities that needn't be those of the sweep. Without edges every node is
    a community.
    """
    both = stored(graph.symmetric(edges), "both")
    whole = float(both.agg(F.sum("weight")).first()[0] or 0.0)
    parts = stored(graph._labelled(nodes, both), "components")
    sizes = both.select(F.col("src").alias("id")).join(parts, "id").groupBy("component").agg(F.count("*").alias("n"))
    giants = stored(sizes.where(F.col("n") > most_edges).select("component"), "giants")
    large = None
    if giants.limit(1).count():  # whole / most_edges of them at most
        inside = parts.join(F.broadcast(giants), "component", "left_semi").select(F.col("id").alias("src"))
        large = _by_rounds(stored(both.join(inside, "src", "left_semi"), "giant_edges"), whole)
        parts = parts.join(F.broadcast(giants), "component", "left_anti")
    rows = parts.join(both.withColumnRenamed("src", "id"), "id", "left").select("component", "id", "dst", "weight")

    def run(t: pa.Table) -> pa.Table:
        ids = pc.unique(t["id"].combine_chunks())
        ids = ids.take(pc.array_sort_indices(ids))
        linked = t.filter(pc.is_valid(t["dst"]))
        at = lambda c: pc.index_in(linked[c].combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
        i, j = at("id"), at("dst")
        order = np.lexsort((j, i))
        i, j, w = i[order], j[order], linked["weight"].to_numpy()[order]
        cuts = np.searchsorted(i, np.arange(len(ids) + 1))
        lists = [[x[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in (j, w)]
        own = _moved(*lists, whole) if whole else list(range(len(ids)))
        lowest: dict[int, int] = {}
        for v, c in enumerate(own):
            lowest.setdefault(c, v)
        return pa.Table.from_arrays([ids.cast(pa.string()), ids.take(pa.array([lowest[c] for c in own], pa.int64())).cast(pa.string())], names=["id", "community"])

    small = rows.groupBy("component").applyInArrow(run, "id string, community string")
    return small if large is None else small.unionByName(large.select(F.col("id").cast("string").alias("id"), F.col("community").cast("string").alias("community")))


def theme_labels(members: DataFrame) -> DataFrame:
    """community, label: names in order joined by commas, up to LABEL_CHARACTERS on a name's end, with … where cut."""
    # a name and its comma have two characters at least, so no more names than this can show
    first = top(members, ["community"], [F.col("name")], LABEL_CHARACTERS)
    names = first.groupBy("community").agg(F.array_sort(F.collect_list("name")).alias("_n"))
    start = F.struct(F.lit("").alias("label"), F.lit(False).alias("cut"))

    def add(a, x):
        longer = F.when(a["label"] == "", x).otherwise(F.concat(a["label"], F.lit(", "), x))
        over = a["cut"] | ((F.length(longer) > LABEL_CHARACTERS) & (a["label"] != ""))
        return F.struct(F.when(over, a["label"]).otherwise(longer).alias("label"), over.alias("cut"))

    return names.select("community", F.aggregate("_n", start, add, lambda a: F.when(a["cut"], F.concat(a["label"], F.lit("…"))).otherwise(a["label"])).alias("label"))


def summaries(members: DataFrame, observations: DataFrame) -> DataFrame:
    """community, label, keywords, content, dedup_key, mean_confidence of communities (id, name, community) with live ``observations`` (id, entity_id, content, category, confidence, salience)."""
    known = observations.join(members.select(F.col("id").alias("entity_id"), "name", "community"), "entity_id")
    rank = F
    for i, c in enumerate(CATEGORY_ORDER):
        rank = rank.when(F.col("category") == c, i)
    known = known.withColumn("_score", F.round(F.col("confidence") * F.col("salience"), 6)).withColumn("_rank", rank.otherwise(99))
    w = Window.partitionBy("community").orderBy(F.col("_score").desc(), "_rank", "entity_id", "id")
    best = known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= OBSERVATIONS)
    line = F.format_string("- %s (%s): %s", F.col("name"), F.col("category"), F.regexp_replace(F.trim("content"), r"\s+", " "))
    lines = best.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("l")))), lambda x: x["l"]), "\n").alias("_lines"))
    words = keywords(known.select(F.col("community").alias("group"), "content"), KEYWORDS).groupBy(F.col("group").alias("community"))
    words = words.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("keywords"))
    ids = known.groupBy("community").agg(F.array_join(F.array_sort(F.collect_set(F.col("id").cast("string"))), "\u0001").alias("_obs"), F.avg("confidence").alias("mean_confidence"))
    who = members.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("id")), "\u0001").alias("_members"), F.count("*").alias("size"))
    out = theme_labels(members).join(lines, "community").join(words, "community", "left").join(ids, "community").join(who, "community")
    content = F.concat(F.lit("Theme: "), "label", F.lit("\nKeywords: "), F.coalesce("keywords", F.lit("")), F.lit("\n"), "_lines")
    key = F.substring(F.sha2(F.concat(F.lit(""), F.lit("\u0001"), "_members", F.lit("\u0001"), "_obs"), 256), 1, 16)
    return out.select("community", "size", "label", "keywords", content.alias("content"), key.alias("dedup_key"), "mean_confidence")


def reflect(nodes: DataFrame, edges: DataFrame, observations: DataFrame, known_keys: DataFrame | None = None, least: int = 2, most: int = 25, members: DataFrame | None = None) -> DataFrame:
    """Candidates of communities: label, content, dedup_key, confidence, status (proposed, too_small, too_large, known).

    ``members`` (id, community), if they are known, save finding the communities. Confidence is the observations' mean times 0.5 + 0.5 * min(1, modularity / 0.3). A community whose key is among
    ``known_keys`` (dedup_key) is not proposed again.
    """
    members = stored(louvain(nodes, edges), "members") if members is None else members
    named = members.join(nodes.select("id", "name"), "id")
    cohesion = graph.modularity(members.withColumnRenamed("community", "component"), edges).withColumnRenamed("component", "community")
    out = summaries(named, observations).join(cohesion, "community", "left")
    lift = 0.5 + 0.5 * F.least(F.greatest(F.coalesce("modularity", F.lit(0.0)) / 0.3, F.lit(0.0)), F.lit(1.0))
    out = out.withColumn("confidence", F.round(F.col("mean_confidence") * lift, 6))
    seen = F.lit(False)
    if known_keys is not None:
        out = out.join(known_keys.select("dedup_key", F.lit(True).alias("_seen")).distinct(), "dedup_key", "left")
        seen = F.coalesce("_seen", F.lit(False))
    status = F.when(F.col("size") < least, "too_small").when(F.col("size") > most, "too_large").when(seen, "known").otherwise("proposed")
    return out.withColumn("status", status).select("community", "size", "label", "content", "dedup_key", "confidence", "status")
