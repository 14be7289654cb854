"""Streams with keyed state that forgets: events whose repeats are dropped, and files whose changes are found from listings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from memspark.operators.evidence import recent_files
from memspark.streaming.ingest import DEDUP_SOURCES, prepared

LISTING = "path string, modified timestamp, polled_at timestamp"


@contextmanager
def keyed_state(spark: SparkSession, idle: bool = True) -> Iterator[None]:
    """Queries started within keep their state in the store that keyed state needs; the session's own settings come back.

    Without ``idle``, no batch runs that has no rows: a clock would else ask for one after the other.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower(),
    }
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


class _Once(StatefulProcessor):
    """Lets the first row of a key through, the earliest of its batch; a key that isn't seen for ``keep`` milliseconds is forgotten."""

    def __init__(self, at: str, keep: int):
        self.at, self.keep = at, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "n long", self.keep)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, n = None, 0
        was = self.known.get() if self.known.exists() else None
        for part in rows:
            n += len(part)
            if was is None:
                least = part.sort_values(self.at, kind="stable").iloc[[0]]
                first = least if first is None or least[self.at].iloc[0] < first[self.at].iloc[0] else first
        self.known.update(((was[0] if was else 0) + n,))
        if first is not None:
            yield first

    def close(self) -> None:
        pass


class _Changed(StatefulProcessor):
    """Lets a path through when a listing shows another time of change than the listing before; forgets it when no listing can show that time again."""

    def __init__(self, since: int):
        self.since = since

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("modified", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        was = self.known.get()[0] if self.known.exists() else None
        seen = pd.concat(list(rows)).drop_duplicates(["modified", "polled_at"]).sort_values(["polled_at", "modified"])
        turns = seen["modified"].astype("datetime64[us]").astype("int64")
        new = seen[turns.ne(turns.shift(fill_value=was if was is not None else -1))]
        last = int(turns.iloc[-1])
        if was != last:
            self.known.update((last,))
            self.handle.registerTimer(last // 1000 + self.since)
        if len(new):
            yield new.iloc[[-1]]

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.known.exists() and self.known.get()[0] // 1000 + self.since <= timerValues.getCurrentWatermarkInMs():
            self.known.clear()
        return iter(())

    def close(self) -> None:
        pass


def once(events: DataFrame, keys: list[str], at: str, keep_seconds: int) -> DataFrame:
    """The first of a stream's rows for each combination of ``keys``, by the column ``at``; nulls are a value of their own.

    A combination that no row has had for ``keep_seconds`` of the clock is forgotten, so the state holds what is current, not
    all that ever came. No row is too late to count. Repeats drop within a batch, between batches and over restarts.
    """
    names = events.columns
    plain = events.toDF(*[f"c{i}" for i in range(len(names))])  # in tasks, rows are named tuples: not every name will do
    run = _Once(f"c{names.index(at)}", keep_seconds * 1000)
    grouped = plain.groupBy(*[f"c{names.index(k)}" for k in keys])
    return grouped.transformWithStateInPandas(run, plain.schema, outputMode="append", timeMode="processingTime").toDF(*names)


def ingest_keyed(events: DataFrame, path: str, checkpoint: str, keep_seconds: int = 30 * 86_400) -> StreamingQuery:
    """Appends a stream of capture events to ``path`` as ``ingest`` does, with state of bounded age: see ``once``.

    An event without captured_at counts as captured when it comes; its captured_at stays null.
    """
    at = "_captured"
    ready = prepared(events).withColumn(at, F.coalesce("captured_at", F.current_timestamp()))
    known = ready["source_type"].isin(*DEDUP_SOURCES)
    first = once(ready.where(known), ["scope", "source_type", "content_hash"], at, keep_seconds)
    both = first.unionByName(ready.where(~F.coalesce(known, F.lit(False)))).drop(at)
    with keyed_state(events.sparkSession, idle=False):
        return both.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def list_files(spark: SparkSession, folder: str, listings: str, since_seconds: int, pattern: str = "*") -> None:
    """Appends a listing (LISTING) of the files of ``folder`` that changed in the last ``since_seconds`` to ``listings``."""
    now = F.current_timestamp()
    files = recent_files(spark, folder, pattern).select("path", "modified", now.alias("polled_at"))
    files.where(F.col("modified") >= now - F.make_dt_interval(secs=F.lit(since_seconds))).write.mode("append").parquet(listings)


def changes_of(listings: DataFrame, since_seconds: int, late: str = "1 minute") -> DataFrame:
    """path, modified, polled_at of a stream of listings (LISTING): a path when its time of change isn't that of the listing before.

    A batch gives a path once, in its newest state. Listings hold files that changed within ``since_seconds`` before them; a path is
    forgotten when polled_at, less ``late``, has passed that: no listing can show it unchanged again. So the state holds the files
    of one look-back, and forgetting repeats nothing. Listings must not come later than ``late`` behind others.
    Rows without path, modified or polled_at are no files.
    """
    rows = listings.where("path IS NOT NULL AND modified IS NOT NULL AND polled_at IS NOT NULL").select("path", "modified", "polled_at")
    rows = rows.withWatermark("polled_at", late)
    return rows.groupBy("path").transformWithStateInPandas(_Changed(since_seconds * 1000), LISTING, outputMode="append", timeMode="eventTime")


def watch_changes(spark: SparkSession, listings: str, then, checkpoint: str, since_seconds: int, every: str | None = None, files: int = 100, late: str = "1 minute") -> StreamingQuery:
    """Gives what changed by the listings under ``listings`` to ``then``(files, batch), each listing read once; without ``every`` until what is there is read."""
    stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", files).parquet(listings)
    with keyed_state(spark):
        out = changes_of(stream, since_seconds, late).writeStream.foreachBatch(then).option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()
