"""op13: the repair of conversations against a plain reading of its contract."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from memspark.llm.conversations import cheapest, damaged, repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def least(rows, deleted):
    """(cost, audit, lines) of the cheapest edits of (role, text) rows: every edit at every row, two inserts in a row at most."""
    ways = {"": (0, "", ())}  # by roles written: nothing, s, or the last of u and a
    grow = lambda state, way, initial: None if initial not in {"": "su", "s": "u", "u": "a", "a": "u"}[state] else (initial, way)
    for i in range(len(rows) + 1):
        for _ in range(2):
            for state, (cost, audit, lines) in list(ways.items()):
                for role in ("user", "assistant"):
                    if grow(state, None, role[0]):
                        new = (cost + 2, audit + "I", (*lines, f"{role}:"))
                        ways[role[0]] = min(ways.get(role[0], new), new)
        if i == len(rows):
            break
        (role, text), after = rows[i], {}
        last = re.sub(r"[\x20\x09-\x0D]", "", text)[-1:]
        for state, (cost, audit, lines) in ways.items():
            options = [(state, (cost + 3, audit + "D", lines))]
            if not deleted[i]:
                more = last not in (".", "!", "?")
                for edit, to, price in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if to[:1] and grow(state, None, to[0]):
                        options.append((to[0], (cost + price + more, audit + edit, (*lines, f"{to}:{text}"))))
            for to, way in options:
                after[to] = min(after.get(to, way), way)
        ways = after
    return min(ways[s] for s in ("", "a") if s in ways)


def plain(rows):
    found = {}
    for conv, turn, role, text in rows:
        own = found.setdefault(conv, [])
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        own.extend([(turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1))
    out = []
    for conv, own in found.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, counts, deleted = set(), [0, 0, 0], []
        for _, role, text in own:
            word = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not word else 1 if (role, text) in seen else 2 if word[-1] not in ".!?" else None
            seen.add((role, text))
            deleted.append(fault in (0, 1))
            if fault is not None:
                counts[fault] += 1
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        turns = {t for t, *_ in own if t is not None}
        cost, audit, lines = least([r[1:] for r in own], deleted)
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, conversations, most):
    rnd = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(rnd.randint(0, most)):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rnd.choice(["Yes.", "No!", "Why?", "word", " \t\n", "", "\u00a0", "a. b", None, "é" * 50 + "."])
            rows.append((conv, rnd.choice([turn, turn, turn * 2, 3, None]), role, text))
    return rows


def result(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_same_as_plain_reading(spark):
    rows = rows_of(5, 150, 12)
    assert result(repair(damaged(spark.createDataFrame(rows, SCHEMA)))) == plain(rows)


@pytest.mark.parametrize(("long_rows", "piece"), [(1, 1), (4, 3), (12, 5)])
def test_pieces_give_the_same(spark, long_rows, piece):
    rows = rows_of(6, 40, 30)
    df = damaged(spark.createDataFrame(rows, SCHEMA))
    assert result(repair(df, long_rows=long_rows, piece=piece)) == plain(rows)


def test_one_conversation_with_most_rows(spark):
    rnd = random.Random(7)
    rows = [(1, t, rnd.choice(["user", "assistant"]), rnd.choice(["Yes.", "no", f"Text {t}."])) for t in range(3000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hi!")]
    assert result(repair(damaged(spark.createDataFrame(rows, SCHEMA)))) == plain(rows)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert result(repair(damaged(df))) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_odd_tables(spark):
    assert result(repair(damaged(spark.createDataFrame([], SCHEMA)))) == []
    df = spark.createDataFrame([(1, 0, "user", "Yes. " * 100_000), (1, 1, "assistant", "Yes." * 3)], SCHEMA)
    clash = df.withColumns({c: F.lit(1) for c in ("n", "_conv", "part", "seq", "first", "_long", "repeated")})
    assert result(repair(damaged(clash), long_bytes=10)) == result(repair(damaged(df))) == plain([tuple(r) for r in df.collect()])


def test_audits_are_cheapest_and_least():
    assert cheapest("") == (0, "")
    assert cheapest("u") == (2, "KI")
    assert cheapest("us") == (2, "KR")
    assert cheapest("sua") == (0, "KKK")
    assert cheapest("s") == (3, "D")
    assert cheapest("U") == (3, "D")  # as cheap as KI: 0 + 1 + 2
