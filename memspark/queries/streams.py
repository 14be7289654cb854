"""Queries that run streams with keyed state over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memspark.operators.stored import shared_dir
from memspark.streaming.ingest import DEDUP_SOURCES
from memspark.streaming.keyed import ingest_keyed, watch_changes
from memspark.tables import table

C = F.col
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
SOURCES = ("transcript", "terminal", "file", "screen", "git", "ide", "browser")


def register(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


@register("st1_keyed_ingest", f"""WITH e AS (SELECT 'u/' || (user_id % 50) AS scope, [{', '.join(map(repr, SOURCES))}][event_id % {len(SOURCES)} + 1] AS source_type, event_type || ' of ' || (user_id % 50) AS text FROM events)
  SELECT scope, source_type, text, CASE WHEN source_type IN {DEDUP_SOURCES} THEN 1 ELSE count(*) END AS n FROM e GROUP BY 1, 2, 3""")
def st1(spark, sf_dir):
    """Events as a stream of captures, from sources whose repeats drop and from others."""
    given = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(given.schema).parquet(f"{sf_dir}/{{events}}.parquet")  # a pattern: a stream's path may not be one file
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (C("event_id") % len(SOURCES) + 1).cast("int"))
    user = (C("user_id") % 50).cast("string")
    events = stream.select(
        F.concat(F.lit("u/"), user).alias("scope"), source.alias("source_type"), C("event_type").alias("source"), C("event_type").alias("title"),
        F.concat("event_type", F.lit(" of "), user).alias("text"), F.lit("internal").alias("privacy_level"), C("ts").cast("timestamp").alias("captured_at"),
    )
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    ingest_keyed(events, f"{folder}/events", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/events").groupBy("scope", "source_type", "text").agg(F.count("*").alias("n"))


@register("st2_watched_changes", """WITH l AS (SELECT page_id, k, (k + page_id % 3) // 2 AS v FROM pages, range(1, 4) r(k) WHERE page_id % 5 <> k),
  c AS (SELECT *, lag(v) OVER (PARTITION BY page_id ORDER BY k) AS was FROM l)
  SELECT page_id::VARCHAR AS path, k AS poll, TIMESTAMP '2024-01-01' + v * INTERVAL 1 DAY AS modified FROM c WHERE v IS DISTINCT FROM was""")
def st2w(spark, sf_dir):
    """Pages as files in three listings, some of them missing from one; after each listing the stream goes on from its checkpoint."""
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    day, pages = F.lit("2024-01-01 00:00:00").cast("timestamp"), table(spark, sf_dir, "pages").select("page_id")
    for k in (1, 2, 3):
        version = F.floor((F.lit(k) + C("page_id") % 3) / 2).cast("int")
        at = day + F.make_dt_interval(days=F.lit(5), mins=F.lit(k))
        listing = pages.where(C("page_id") % 5 != k).select(C("page_id").cast("string").alias("path"), (day + F.make_dt_interval(days=version)).alias("modified"), at.alias("polled_at"))
        listing.write.mode("append").parquet(f"{folder}/listings")
        watch_changes(spark, f"{folder}/listings", lambda found, n: found.write.mode("overwrite").parquet(f"{folder}/found/batch={n}"), f"{folder}/state", 30 * 86_400).awaitTermination()
    found = spark.read.parquet(f"{folder}/found")
    return found.select("path", F.minute("polled_at").cast("long").alias("poll"), "modified")
