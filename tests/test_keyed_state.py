"""Streams with keyed state: repeats drop over batches and restarts, state is forgotten, and nothing comes twice."""

import time

from memspark.streaming.ingest import DEDUP_SOURCES
from memspark.streaming.keyed import LISTING, ingest_keyed, list_files, watch_changes

EVENT = "scope string, source_type string, source string, title string, text string, privacy_level string, captured_at timestamp"


def _events(spark, folder, rows):
    values = ", ".join(f"('a', '{s}', 'f', 't', {t}, 'internal', {at})" for s, t, at in rows)
    names = EVENT.replace(" string", "").replace(" timestamp", "")
    spark.sql(f"SELECT * FROM VALUES {values} AS t({names})").coalesce(1).write.mode("append").json(folder)


def test_repeats_drop_until_they_are_forgotten(spark, tmp_path):
    at, source = "timestamp '2024-01-01 00:00:0{}'", str(tmp_path / "in")

    def run(keep=3600, name="one"):
        stream = spark.readStream.schema(EVENT).json(source)
        ingest_keyed(stream, str(tmp_path / name / "out"), str(tmp_path / name / "state"), keep).awaitTermination()
        return [(r.source_type, r.text, r.captured_at and r.captured_at.second) for r in spark.read.parquet(str(tmp_path / name / "out")).collect()]

    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    _events(spark, source, [("git", "'x'", at.format(3)), ("git", "'x'", at.format(1)), ("terminal", "'x'", at.format(1)), ("terminal", "'x'", at.format(1)), ("ide", "NULL", "NULL")])
    first = [("git", "x", 1), ("ide", None, None), ("terminal", "x", 1), ("terminal", "x", 1)]
    key = lambda r: (r[0], r[1] or "", r[2] or 0)
    assert sorted(run(), key=key) == sorted(run(1, "two"), key=key) == first
    # a repeat, one much earlier than what came before, a null text again, and a new text
    _events(spark, source, [("git", "'x'", at.format(5)), ("git", "'x'", "timestamp '2020-01-01'"), ("ide", "NULL", "NULL"), ("git", "'y'", "timestamp '2020-01-01'")])
    assert sorted(run(), key=key) == sorted([*first, ("git", "y", 0)], key=key)
    assert sorted(run(), key=key) == sorted([*first, ("git", "y", 0)], key=key)  # nothing new, nothing twice
    time.sleep(2)
    assert sorted(run(1, "two"), key=key) == sorted([*first, ("git", "y", 0), ("git", "x", 0), ("ide", None, None)], key=key)  # forgotten by then
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == store and "git" in DEDUP_SOURCES


def test_changes_come_once_and_paths_are_forgotten(spark, tmp_path):
    listings, found, rows = str(tmp_path / "listings"), [], []

    def poll(polled, files):
        spark.sql("SELECT * FROM VALUES " + ", ".join(f"({p}, timestamp '{m}', timestamp '{polled}')" for p, m in files) + " AS t(path, modified, polled_at)").selectExpr(
            "CAST(path AS string) path", "modified", "polled_at").coalesce(1).write.mode("append").parquet(listings)
        found.clear()
        query = watch_changes(spark, listings, lambda df, n: found.extend((r.path, str(r.modified)[5:16]) for r in df.collect()), str(tmp_path / "state"), 600, late="0 seconds")
        query.awaitTermination()
        state = next(s for p in reversed(query.recentProgress) for s in p.stateOperators)
        rows.append(state.numRowsTotal)
        return sorted(found)

    assert poll("2024-01-01 10:00:00", [("'a'", "2024-01-01 09:55:00"), ("'b'", "2024-01-01 09:56:00"), ("NULL", "2024-01-01 09:56:00")]) == [("a", "01-01 09:55"), ("b", "01-01 09:56")]
    assert poll("2024-01-01 10:01:00", [("'a'", "2024-01-01 09:55:00"), ("'a'", "2024-01-01 09:55:00"), ("'b'", "2024-01-01 10:00:30")]) == [("b", "01-01 10:00")]
    assert poll("2024-01-01 10:02:00", [("'a'", "2024-01-01 09:55:00"), ("'b'", "2024-01-01 10:00:30")]) == []
    assert poll("2024-01-01 12:00:00", [("'c'", "2024-01-01 11:59:00")]) == [("c", "01-01 11:59")]
    assert rows[0] >= 2 and rows[-1] < rows[2]  # a and b can't be listed unchanged again, and are gone
    assert poll("2024-01-01 12:01:00", [("'a'", "2024-01-01 12:00:30"), ("'c'", "2024-01-01 11:59:00")]) == [("a", "01-01 12:00")]


def test_listings_of_a_folder(spark, tmp_path):
    import os

    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "new.txt").write_text("1")
    (folder / "old.txt").write_text("1")
    os.utime(folder / "old.txt", (1_000_000_000, 1_000_000_000))
    for _ in range(2):
        list_files(spark, str(folder), str(tmp_path / "listings"), 3600)
    got = spark.read.schema(LISTING).parquet(str(tmp_path / "listings")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in got] == ["new.txt", "new.txt"]
    seen = []
    watch_changes(spark, str(tmp_path / "listings"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "state"), 3600).awaitTermination()
    assert len(seen) == 1
