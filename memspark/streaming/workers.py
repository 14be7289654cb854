"""Streaming workers: polling of changed files, the embedding worker, events with sessions, and the tail of a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memspark.operators.capture import attach_sessions
from memspark.operators.embed import embed
from memspark.operators.evidence import recent_files
from memspark.streaming.ingest import prepared

JOBS = "id string, record_type string, record_id string, scope string, content_hash string, created_at timestamp"


def changed_files(files: DataFrame, seen: DataFrame, since: str | None = None) -> DataFrame:
    """``files`` (path, modified, ...) modified at ``since`` or later whose (path, modified) ``seen`` doesn't have, each path once, its newest state."""
    new = files if since is None else files.where(F.col("modified") >= F.lit(since).cast("timestamp"))
    newest = new.groupBy("path").agg(F.max("modified").alias("modified"))
    return newest.join(seen.select("path", "modified").distinct(), ["path", "modified"], "left_anti")


def poll(spark: SparkSession, folder: str, seen: str, batch: int, pattern: str = "*", since: str | None = None) -> DataFrame:
    """The files of ``folder`` that changed since the polls before; what poll ``batch`` finds is kept under ``seen``, so a repeated poll finds the same."""
    earlier = spark.createDataFrame([], "path string, modified timestamp, batch long") if not batch else spark.read.schema("path string, modified timestamp, batch long").parquet(seen)
    found = changed_files(recent_files(spark, folder, pattern), earlier.where(F.col("batch") < batch), since)
    found.write.mode("overwrite").parquet(f"{seen}/batch={batch}")
    return spark.read.schema("path string, modified timestamp").parquet(f"{seen}/batch={batch}")


def watch(spark: SparkSession, folder: str, seen: str, then, checkpoint: str, every: str = "2 seconds", pattern: str = "*", since: str | None = None) -> StreamingQuery:
    """Polls ``folder`` each ``every`` and gives what changed to ``then``(files, batch)."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(lambda _, n: then(poll(spark, folder, seen, n, pattern, since), n)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def embedding_worker(spark: SparkSession, jobs: str, records, vectors: str, outcomes: str, checkpoint: str, every: str | None = None, files: int = 100) -> StreamingQuery:
    """Embeds jobs (Parquet files of JOBS under ``jobs``) as they come: a batch's vectors and outcomes go under ``vectors`` and ``outcomes``.

    ``records`` is a function that gives the current embeddable records. A batch that runs again after a failure writes the same
    folders again. Without ``every`` it works off what is there and ends.
    """
    stream = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", files).parquet(jobs)

    def run(batch: DataFrame, n: int) -> None:
        made, done = embed(batch, records())
        made.write.mode("overwrite").parquet(f"{vectors}/batch={n}")
        done.write.mode("overwrite").parquet(f"{outcomes}/batch={n}")

    out = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def ingest_with_sessions(events: DataFrame, sessions: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of events, redacted and with the capture session that each belongs to, to ``path``."""
    ready = attach_sessions(prepared(events), sessions)
    return ready.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tail(log: DataFrame, after, key: str = "event_id") -> DataFrame:
    """Rows of a log, a table or a stream, whose ``key`` is above the cursor ``after``."""
    return log.where(F.col(key) > F.lit(after))
