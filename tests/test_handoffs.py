"""Handoffs close a session, open its child, and say so in two events."""

from pyspark.sql import functions as F

from memspark.plans import assist

SESSION = (
    "id string, session_type string, project string, scope string, goal string, status string, parent_session string, child_session string, handoff_context string, "
    "started_at timestamp, ended_at timestamp, summary string, accomplishments array<string>, remaining array<string>, files_changed array<string>"
)


def test_sessions_are_handed_off_once(spark):
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    none = (None,) * 3
    rows = [
        ("a", "codex", "p", "x/y", "g", "active", *none, day(1), None, "  ", ["one", "two"], None, []),
        ("b", "codex", "p", "", None, "active", *none, day(2), None, "sum", None, ["left"], ["f.py"]),
        ("c", "codex", "q", "x", "g", "completed", *none, day(3), day(4), None, None, None, None),
    ]
    sessions = spark.createDataFrame(rows, SESSION)
    asked = spark.createDataFrame([(1, "p", None), (2, "p", "b"), (3, "p", "a"), (4, "q", None), (5, "q", "c"), (6, "q", "zz")], "place int, project string, id string")
    decisions = spark.createDataFrame([("d1", "a", "t1", day(1)), ("d2", "a", "t2", day(2)), ("d3", "a", "t3", day(3)), ("d9", "c", "t", day(1))], "id string, decided_in string, title string, created_at timestamp")
    state = spark.createDataFrame([("k1", "x", "n1", "blocked", day(1)), ("k2", "x/y", "n2", "planned", day(2)), ("k3", "z", "n3", "planned", day(3))], "key string, scope string, title string, status string, updated_at timestamp")
    got = assist.hand_off(sessions, asked, decisions, state, F.lit("2025-01-01 00:00:00").cast("timestamp"), 2)
    assert {tuple(r) for r in got["rejected"].collect()} == {(4, "no active session"), (5, "already completed"), (6, "not found")}
    after = {r.id: r for r in got["sessions"].collect()}
    assert len(after) == 5 and after["c"].status == "completed" and after["c"].child_session is None
    for parent in ("a", "b"):
        old, new = after[parent], after[after[parent].child_session]
        assert (old.status, old.ended_at, new.status, new.parent_session, new.scope, new.goal, new.started_at) == ("handed-off", datetime(2025, 1, 1), "active", parent, old.scope, old.goal, datetime(2025, 1, 1))
        assert new.ended_at is None and new.handoff_context is None and len(new.id) == 26
    events = sorted((r.event_type, r.target_id) for r in got["events"].collect())
    assert events == sorted([("session_handoff", "a"), ("session_handoff", "b"), *(("session_started", after[x].child_session) for x in "ab")])
    text = after["a"].handoff_context
    for part in ("- Scope: x/y\n- Goal: g\n\n## Summary\n- None recorded.\n", "## Accomplishments\n- one\n- two\n", "## Files Changed\n- None recorded.\n", "## Decisions Made\n- d3: t3\n- d2: t2\n\n", "## Relevant Active Work\n- k2: n2 [planned]\n- k1: n1 [blocked]\n\nStart"):
        assert part in text
    text = after["b"].handoff_context
    for part in ("- Scope: global\n- Goal: No goal recorded\n\n## Summary\nsum\n", "## Remaining\n- left\n", "## Files Changed\n- f.py\n", "## Decisions Made\n- None recorded.\n", "## Relevant Active Work\n- None recorded.\n"):
        assert part in text


def test_nothing_asked_changes_nothing(spark):
    sessions = spark.createDataFrame([], SESSION)
    asked = spark.createDataFrame([], "place int, project string, id string")
    decisions = spark.createDataFrame([], "id string, decided_in string, title string, created_at timestamp")
    state = spark.createDataFrame([], "key string, scope string, title string, status string, updated_at timestamp")
    got = assist.hand_off(sessions, asked, decisions, state, F.current_timestamp())
    assert all(not df.count() for df in got.values())


def test_decisions_of_one_time_and_id_come_by_title(spark):
    from datetime import datetime

    none = (None,) * 3
    sessions = spark.createDataFrame([("a", "codex", "p", "", "g", "active", *none, datetime(2024, 1, 1), None, None, None, None, None)], SESSION)
    asked = spark.createDataFrame([(1, "p", "a")], "place int, project string, id string")
    state = spark.createDataFrame([], "key string, scope string, title string, status string, updated_at timestamp")
    for titles in ("NAR", "RAN"):
        decisions = spark.createDataFrame([("2", "a", t, datetime(2024, 1, 1)) for t in titles], "id string, decided_in string, title string, created_at timestamp").coalesce(1)
        context = assist.hand_off(sessions, asked, decisions, state, F.current_timestamp(), 2)["contexts"].first().context
        assert "## Decisions Made\n- 2: A\n- 2: N\n\n" in context
