"""Structured Streaming ingest of capture events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memspark.functions.text import content_hash
from memspark.operators.redact import raised_privacy, redacted

#: Sources whose repeats are dropped; repeats of others (terminal, agent, system, screen, browser) are events of their own.
DEDUP_SOURCES = ("transcript", "file", "git", "ide")


def prepared(events: DataFrame) -> DataFrame:
    """Capture events (scope, source_type, source, title, text, privacy_level, captured_at) with redacted text, raised privacy and content_hash."""
    out = events.withColumn("_r", redacted(F.col("text")))
    out = out.withColumns({"text": F.col("_r.text"), "redacted": F.col("_r.changed"), "privacy_level": raised_privacy(F.col("privacy_level"), F.col("_r.changed"))}).drop("_r")
    hashed = content_hash(F.col("source_type"), F.col("source"), F.col("title"), F.col("text"), F.col("scope"), F.lit(""))
    return out.withColumn("content_hash", hashed)


def ingest(events: DataFrame, path: str, checkpoint: str, late: str | None = None) -> StreamingQuery:
    """Appends a stream of events to ``path``: each batch once, repeats of DEDUP_SOURCES dropped.

    Without ``late`` the state of known hashes grows with the stream; with it, events later than that against the
    watermark may repeat. Runs until what is there now is read.
    """
    keys = ["scope", "source_type", "content_hash"]
    ready = prepared(events)
    once = ready.where(F.col("source_type").isin(*DEDUP_SOURCES))
    once = once.withWatermark("captured_at", late).dropDuplicatesWithinWatermark(keys) if late else once.dropDuplicates(keys)
    rest = ready.where(~F.col("source_type").isin(*DEDUP_SOURCES))
    both = once.unionByName(rest)
    return both.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
