"""Repair of damaged conversations: the cheapest edits that give every conversation legal turns.

A row may be kept, get another role, or be deleted, and empty rows may be inserted anywhere; the roles that are left must be
nothing, or a system row at most and then pairs of user and assistant. Edits walk a lattice whose nodes are (rows read, last
role written). The cheapest walk is found by Dijkstra's algorithm from both ends: a forward heap grows from the start, a
reverse heap from the accepted ends, until no walk through unsettled nodes can be as cheap as the best crossing. Every
crossing of that cost is finished, and of their walks the one with the ASCII-least audit (initials of its edits) is taken.
An audit determines its walk, so no audit of a cost is the beginning of another one between the same nodes; least halves make
the least whole.

Blank and repeated rows must be deleted. They don't touch the lattice: their D stands before what is inserted at that place.

Conversations of LONG rows or bytes are cut into pieces of PIECE rows by a sort over all partitions. A piece is solved for each
pair of roles at its edges; costs of pieces are then summed up from the last to the first, and the edges chosen from the
first to the last (the audits of a piece end with a row that is read, so they too decide alone). No task holds such a
conversation, but for its finished audit; its text is hashed as it streams by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from memspark.llm.store import stored
from memspark.llm.textbatch import small_batches, tidy

#: Rows and bytes from which a conversation is cut, and rows and characters of a piece (one longer text is a piece).
LONG_ROWS, LONG_BYTES, PIECE, PIECE_BYTES = 2_000, 8 << 20, 200, 1 << 19
#: Rows of a batch that is read, characters of one that is given back.
BATCH_ROWS, OUT = 500, 1 << 20
#: Conversations that are broadcast by id, at most.
BROADCAST_ROWS = 400_000
SPACE = " \t\n\x0b\x0c\r"
#: Last role written: none, system, user, assistant. After each, the role that comes next, if not system.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = ("", "system", "user", "assistant")
_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What a conversation lacks after its last row: cost and audit by the last role written.
_TAIL = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))


def _onward(rows: str, at: int, role: int, insert: bool) -> Iterator[tuple[int, int, int, str]]:
    """(rows read, last role, cost, initial) of the edits from a node."""
    if insert:
        yield at, _NEXT[role], INSERT, "I"
    if at < len(rows):
        row = rows[at]
        more = TRUNCATED if row.isupper() else 0
        own = _INITIAL.get(row.lower())
        if own == _NEXT[role] or (own == SYSTEM and role == NONE):
            yield at + 1, own, KEEP + more, "K"
        yield at + 1, _NEXT[role], REROLE + more, "R"
        yield at + 1, role, DELETE, "D"


def _backward(rows: str, at: int, role: int, insert: bool) -> Iterator[tuple[int, int, int, str]]:
    """The edits that lead to a node, from where they come."""
    for before in range(4):
        if insert and _NEXT[before] == role:
            yield at, before, INSERT, "I"
        if at:
            for _, to, cost, initial in _onward(rows, at - 1, before, False):
                if to == role:
                    yield at - 1, before, cost, initial


@lru_cache(1 << 14)
def cheapest(rows: str, start: int = NONE, ends: tuple[int, ...] = (NONE, ASSISTANT), last: bool = True) -> tuple[int, str] | None:
    """Cost and least audit of the cheapest walk over ``rows`` from the role ``start`` to one of ``ends``; None if there is none.

    A row is the initial of its role, or x, as a capital if its text is truncated. Unless it is the ``last`` piece, nothing is
    inserted after its last row. Both heaps are ordered by cost, then by rows read: no walk of the same cost comes late.
    """
    n = len(rows)
    heaps: tuple[list, list] = ([], [])
    found: tuple[dict, dict] = ({(0, start): (0, "")}, {(n, q): (0, "") for q in ends})
    settled: tuple[set, set] = (set(), set())
    best = None

    def settle(side: int, at: int, role: int) -> None:
        nonlocal best
        settled[side].add((at, role))
        cost, audit = found[side][at, role]
        if (at, role) in found[1 - side]:
            whole = cost + found[1 - side][at, role][0]
            best = whole if best is None else min(best, whole)
        for to, then, more, initial in (_backward if side else _onward)(rows, at, role, last or at < n):
            label = (cost + more, initial + audit if side else audit + initial)
            if (to, then) not in found[side] or label < found[side][to, then]:
                found[side][to, then] = label
                heappush(heaps[side], (label[0], n - to if side else to, then))

    settle(0, 0, start)
    for q in ends:
        settle(1, n, q)
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        _, place, role = heappop(heaps[side])
        at = n - place if side else place
        if (at, role) not in settled[side]:
            settle(side, at, role)
    if best is None:
        return None
    # the crossings of that cost: at a settled node, or on an edit between two
    audits = [found[0][v][1] + found[1][v][1] for v in settled[0] & settled[1] if found[0][v][0] + found[1][v][0] == best]
    for at, role in settled[0]:
        cost, audit = found[0][at, role]
        for to, then, more, initial in _onward(rows, at, role, last or at < n):
            if (to, then) in settled[1] and cost + more + found[1][to, then][0] == best:
                audits.append(audit + initial + found[1][to, then][1])
    return best, min(audits)


def _whole_audit(audit: str, deleted: list[int]) -> str:
    """``audit`` with the D of the ``deleted`` rows: so many before the first row, after the first, and so on."""
    out, read = ["D" * deleted[0]], 0
    for edit in audit:
        out.append(edit)
        if edit != "I":
            read += 1
            out.append("D" * deleted[read])
    return "".join(out)


def _repaired(audit: str, rows: list[tuple[str, str]], role: int = NONE) -> Iterator[str]:
    """role:text of the rows that ``audit`` leaves; ``rows`` are those that needn't be deleted."""
    left = iter(rows)
    for edit in audit:
        if edit == "I":
            role = _NEXT[role]
            yield f"{_ROLE[role]}:"
        elif edit == "D":
            next(left)
        else:
            name, text = next(left)
            role = _NEXT[role] if edit == "R" else _INITIAL[name[0]]
            yield f"{name if edit == 'K' else _ROLE[role]}:{text}"


def _symbol(role: str, text: str) -> str:
    """A row for the lattice; None of the faults that delete it is looked at here."""
    initial = role[:1] if role[:1] in _INITIAL else "x"
    return initial if text.rstrip(SPACE)[-1:] in (".", "!", "?") else initial.upper()


def _legal(before: str, role: str) -> bool:
    return before[:1] + role[:1] in ("su", "ua", "au")


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the rows after damage; n is how often the row stands there, 0 for a dropped one."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text)
    n = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), n.alias("n"))


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COLUMNS = ("conv_id", *(f.split()[0] for f in _RESULT.split(", ")))


def _solve(rows: list[tuple[int | None, str, str]]) -> tuple:
    """The result columns of one conversation's rows (turn, role, text) in their order."""
    seen, blank, duplicate, kept, deleted, illegal = set(), 0, 0, [], [0], 0
    for i, (_, role, text) in enumerate(rows):
        illegal += i > 0 and not _legal(rows[i - 1][1], role)
        is_blank = not text.strip(SPACE)
        if is_blank or (role, text) in seen:
            blank += is_blank
            duplicate += not is_blank
            deleted[-1] += 1
        else:
            seen.add((role, text))
            kept.append((role, text))
            deleted.append(0)
    symbols = "".join(_symbol(*r) for r in kept)
    cost, audit = cheapest(symbols)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    digest = hashlib.sha256("\n".join(_repaired(audit, kept)).encode()).hexdigest()
    return gaps, blank, duplicate, sum(map(str.isupper, symbols)), illegal, cost + DELETE * sum(deleted), _whole_audit(audit, deleted), digest


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _in_order(df: DataFrame, by: list[Column], run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``run`` over the rows of each partition of ``df``, sorted; it gives rows of ``schema``. Rows are read and given batch after batch."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in run(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            out.append(row)
            size += sum(len(v) if isinstance(v, str) else 1 for v in row)
            if size > OUT:
                yield _batch(out, kinds)
                out, size = [], 0
        yield _batch(out, kinds)

    return df.sortWithinPartitions(*by).mapInArrow(tidy(mapped), schema)


def _kind(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _rising(*names: str) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in names]


def _short(rows: DataFrame) -> DataFrame:
    """The results of conversations that fit a task, each read as a whole."""

    def run(found: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(found, key=itemgetter(0)):
            yield conv, *_solve([(turn, role, text) for _, turn, role, text, n in own for _ in range(n)])

    return _in_order(rows.repartition("conv_id"), _rising("conv_id", "turn", "role", "text"), run, f"conv_id {_kind(rows)}, {_RESULT}")


_PAIRS = [(a, b) for a in range(4) for b in range(4)]
_PIECE = (
    "seq int, roles array<string>, texts array<string>, deleted array<long>, symbols string, first_role string, last_role string, "
    "blank long, duplicate long, illegal long, costs array<long>, ranks array<int>"
)


def _cut(found: Iterator[tuple], piece: int) -> Iterator[tuple]:
    """Pieces of the runs (conv_id, turn, role, text, n, repeated) of a partition in their order."""
    seq = 0
    for conv, own in groupby(found, key=itemgetter(0)):
        row = next(own)
        while row is not None:
            roles, texts, deleted, blank, duplicate, illegal, size = [], [], [0], 0, 0, 0, 0
            first, last = row[2], None
            while row is not None and len(roles) < piece and size < PIECE_BYTES:
                _, _, role, text, n, repeated = row
                illegal += last is not None and not _legal(last, role)
                illegal += (n - 1) * (not _legal(role, role))
                last, is_blank = role, not text.strip(SPACE)
                blank += n * is_blank
                if not is_blank and not repeated:
                    roles.append(role)
                    texts.append(text)
                    deleted.append(0)
                    size += len(text)
                    n -= 1
                duplicate += n * (not is_blank)
                deleted[-1] += n
                row = next(own, None)
            symbols = "".join(map(_symbol, roles, texts))
            walks = [cheapest(symbols, a, (b,), False) for a, b in _PAIRS]
            audits = sorted({w[1] for w in walks if w})
            ranks = [audits.index(w[1]) if w else -1 for w in walks]
            yield conv, seq, roles, texts, deleted, symbols, first, last, blank, duplicate, illegal, [w[0] if w else -1 for w in walks], ranks
            seq += 1


def _to_go(found: Iterator[tuple]) -> Iterator[tuple]:
    """What is left to pay after each piece, by the last role: pieces (conv_id, part, seq, costs, ranks) come from the last to the first."""
    for _, own in groupby(found, key=itemgetter(0)):
        left = [cost for cost, _ in _TAIL]
        for conv, part, seq, costs, ranks in own:
            yield conv, part, seq, costs, ranks, left
            left = [min(c + left[b] for b in range(4) if (c := costs[4 * a + b]) >= 0) for a in range(4)]


def _choose(found: Iterator[tuple]) -> Iterator[tuple]:
    """The roles at both edges of each piece: the cheapest way, of equal ones the least audit. Pieces come in order, with what is left to pay."""
    for _, own in groupby(found, key=itemgetter(0)):
        role = NONE
        for conv, part, seq, costs, ranks, left in own:
            ways = [(costs[4 * role + b] + left[b], ranks[4 * role + b], b) for b in range(4) if costs[4 * role + b] >= 0]
            start, role = role, min(ways)[2]
            yield part, seq, start, role


def _written(found: Iterator[tuple]) -> Iterator[tuple]:
    """Audit and text of each piece (conv_id, part, seq, roles, texts, deleted, symbols, first_role, last_role, blank, duplicate, illegal, start, end)."""
    for conv, part, seq, roles, texts, deleted, symbols, first, last, blank, duplicate, illegal, start, end in found:
        cost, audit = cheapest(symbols, start, (end,), False)
        lines = list(_repaired(audit, list(zip(roles, texts, strict=True)), start))
        truncated = sum(map(str.isupper, symbols))
        yield conv, part, seq, first, last, blank, duplicate, truncated, illegal, cost + DELETE * sum(deleted), end, _whole_audit(audit, deleted), "\n".join(lines) if lines else None


def _joined(found: Iterator[tuple]) -> Iterator[tuple]:
    """The results of conversations from their pieces in order."""
    for conv, own in groupby(found, key=itemgetter(0)):
        sums, audits, digest, lines, before, end = [0] * 5, [], hashlib.sha256(), 0, None, NONE
        for _, _, _, first, last, *counts, end, audit, text in own:
            sums = [a + b for a, b in zip(sums, counts, strict=True)]
            sums[3] += before is not None and not _legal(before, first)
            before = last
            audits.append(audit)
            if text is not None:
                digest.update((b"\n" if lines else b"") + text.encode())
                lines += 1
        cost, audit = _TAIL[end]
        for line in _repaired(audit, [], end):
            digest.update((b"\n" if lines else b"") + line.encode())
            lines += 1
        yield conv, *sums[:4], sums[4] + cost, "".join(audits) + audit, digest.hexdigest()


def _long(rows: DataFrame, piece: int) -> DataFrame:
    """The results of long conversations, a piece at a time."""
    by, kind = ("conv_id", "turn", "role", "text"), _kind(rows)
    runs = stored(rows.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n")), "conversation_runs")
    # a text that a role has said before, other than in the same turn: only those that stand in several turns are joined
    turn = F.struct(F.col("turn").isNotNull().alias("x"), F.col("turn").alias("turn"))
    again = runs.groupBy("conv_id", "role", "text").agg(F.min(turn).alias("first"), F.count("*").alias("k")).where("k > 1")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("text").alias("_text"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))
    runs = runs.join(again, same, "left").select(*by, "n", F.coalesce(F.col("first") < turn, F.lit(False)).alias("repeated"))
    ordered = runs.repartitionByRange(*_rising(*by))
    pieces = _in_order(ordered, _rising(*by), partial(_cut, piece=piece), f"conv_id {kind}, {_PIECE}")
    pieces = stored(pieces.withColumn("part", F.spark_partition_id()), "conversation_pieces")
    small = pieces.select("conv_id", "part", "seq", "costs", "ranks").repartition("conv_id")
    falling = [F.col("conv_id").asc_nulls_first(), F.desc("part"), F.desc("seq")]
    edges = f"conv_id {kind}, part int, seq int, costs array<long>, ranks array<int>, left array<long>"
    to_go = _in_order(small, falling, _to_go, edges)
    chosen = _in_order(to_go, _rising("conv_id", "part", "seq"), _choose, "part int, seq int, start int, end int")
    whole = pieces.drop("costs", "ranks").join(stored(chosen, "conversation_edges"), ["part", "seq"])
    columns = ("conv_id", "part", "seq", "roles", "texts", "deleted", "symbols", "first_role", "last_role", "blank", "duplicate", "illegal", "start", "end")
    schema = f"conv_id {kind}, part int, seq int, first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, cost long, end int, audit string, text string"
    written = stored(_in_order(whole.select(*columns), [F.col("part")], _written, schema), "conversation_texts")
    found = _in_order(written.repartition("conv_id"), _rising("conv_id", "part", "seq"), _joined, f"conv_id {kind}, {_RESULT.removeprefix('gaps long, ')}")
    gaps = rows.where("n > 0").groupBy(F.col("conv_id").alias("_conv")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    return found.join(gaps, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*_COLUMNS)


def repair(rows: DataFrame, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, piece: int = PIECE) -> DataFrame:
    """gaps, faults, cost, audit and the digest of the repaired text of every conversation of ``rows`` (conv_id, turn, role, text, n).

    ``n`` is how often a row stands there; a conversation of which none does has zeros, an empty audit and the digest of
    nothing. Rows are taken by turn (null first), then by role and text. Null ids are one conversation. Repeated rows are
    repeated turns. An empty table gives none; other columns aren't read.
    """
    rows = stored(rows.select("conv_id", "turn", "role", "text", "n"), "conversations")
    sizes = rows.groupBy("conv_id").agg(F.sum("n").alias("rows"), F.sum(F.octet_length("text") * F.col("n")).alias("bytes"))
    long = stored(sizes.where((F.col("rows") >= long_rows) | (F.col("bytes") >= long_bytes)).select(F.col("conv_id").alias("_long")), "long_conversations")
    n = long.limit(BROADCAST_ROWS + 1).count()
    with small_batches(rows.sparkSession, BATCH_ROWS):
        if not n:
            return stored(_short(rows), "repaired")
        long = F.broadcast(long) if n <= BROADCAST_ROWS else long
        same = F.col("conv_id").eqNullSafe(F.col("_long"))
        return stored(_short(rows.join(long, same, "left_anti")), "repaired").unionByName(stored(_long(rows.join(long, same, "left_semi"), piece), "repaired_long"))
