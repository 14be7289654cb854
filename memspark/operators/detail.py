"""One record from all sides, and the snapshot of a scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators.search import top

RELATED, EVENTS = 12, 8


def record_detail(records: DataFrame, metadata: dict[str, str], related: DataFrame, events: DataFrame) -> DataFrame:
    """id, title, metadata, related, events of ``records`` (id, title, ...).

    ``metadata`` names columns by label: "label=value" of those that aren't null, in order. ``related`` (id, other,
    relation, weight) gives the RELATED heaviest, ``events`` (target_id, event_type, created_at, event_id) the EVENTS newest.
    Both are cut before they are collected.
    """
    pairs = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}="), F.col(c).cast("string"))) for label, c in metadata.items()]), lambda x: x.isNotNull())
    in_order = lambda x: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", x.alias("x")))), lambda y: y["x"]), ",")
    near = top(related, ["id"], [F.col("weight").desc(), F.col("other"), F.col("relation")], RELATED)
    near = near.groupBy("id").agg(in_order(F.concat_ws(":", "relation", "other")).alias("related"))
    newest = top(events, ["target_id"], [F.col("created_at").desc(), F.col("event_id").desc()], EVENTS)
    newest = newest.groupBy(F.col("target_id").alias("id")).agg(in_order(F.concat_ws(":", "event_type", F.col("event_id").cast("string"))).alias("events"))
    out = records.select("id", "title", F.array_join(pairs, ",").alias("metadata")).join(near, "id", "left").join(newest, "id", "left")
    return out.na.fill("", ["related", "events"])


def snapshot(scopes: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """query_scope, section, body: the ``parts`` (query_scope, body) of each of ``scopes``, a part that has nothing for a scope saying so."""
    rows = None
    for name, part in parts.items():
        one = scopes.select("query_scope").distinct().join(part.select("query_scope", "body"), "query_scope", "left")
        one = one.select("query_scope", F.lit(name).alias("section"), F.coalesce("body", F.lit("unavailable")).alias("body"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
