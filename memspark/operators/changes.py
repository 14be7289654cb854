"""Applying batches of changes to tables: upserts, deletes, partial updates and the events they emit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert_latest(base: DataFrame, changes: DataFrame, key: list[str], order: list[Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """``base`` with the last change of each key in place of its row; columns in ``keep`` (such as created_at) stay as they were."""
    w = Window.partitionBy(*key).orderBy(*order)
    last = changes.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*base.columns)
    old = base.select(*key, *[F.col(c).alias(f"_old_{c}") for c in keep])
    last = last.join(old, key, "left").select(*[F.coalesce(f"_old_{c}", c).alias(c) if c in keep else F.col(c) for c in base.columns])
    return base.join(last.select(*key), key, "left_anti").unionByName(last)


def insert_new(base: DataFrame, rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Rows of keys that ``base`` doesn't have, the first of each."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.join(base.select(*key).distinct(), key, "left_anti").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def delete_cascade(rows: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose ``columns`` names an id in ``gone`` (id)."""
    for c in columns:
        rows = rows.join(gone.select(F.col("id").alias(c)).distinct(), c, "left_anti")
    return rows


def close(rows: DataFrame, gone: DataFrame, at: Column) -> DataFrame:
    """Rows with valid_to set where they are live and their id is in ``gone`` (id)."""
    marked = rows.join(gone.select("id", F.lit(True).alias("_gone")).distinct(), "id", "left")
    return marked.withColumn("valid_to", F.when(F.col("_gone") & F.col("valid_to").isNull(), at).otherwise(F.col("valid_to"))).drop("_gone")


def patch(base: DataFrame, commands: DataFrame, key: str, columns: list[str], order: str, version: str | None = None) -> DataFrame:
    """``base`` with each column's last value that is not null among the key's commands; ``version`` grows by their number."""
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in columns]
    merged = commands.groupBy(key).agg(*last, F.count("*").alias("_times"))
    out = base.join(merged, key, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
    if version:
        out = out.withColumn(version, F.col(version) + F.coalesce("_times", F.lit(0)))
    return out.select(*base.columns)


def emitted(changes: DataFrame, kind: Column, target: Column, at: Column) -> DataFrame:
    """One event row for each change: id, event_type, target_id, created_at; ids are hashes, so reruns agree."""
    id_ = F.substring(F.sha2(F.concat_ws("\u001f", kind, target.cast("string"), at.cast("string")), 256), 1, 26)
    return changes.select(id_.alias("id"), kind.alias("event_type"), target.cast("string").alias("target_id"), at.alias("created_at"))


def first_of(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def supersede(facts: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts with closed windows, what was invalidated) for ``incoming`` facts that name the fact they replace (supersedes).

    A fact is closed at the new one's start if it is live, both are of one entity, and arbitration lets the incoming one
    win; of several winners the earliest id closes it.
    """
    from memspark.functions.facts import arbitrate

    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    old = facts.where("valid_to IS NULL").select(F.col("id").alias("supersedes"), "entity_id", F.col("source_type").alias("_s"), F.col("confidence").alias("_c"), F.col("valid_from").alias("_f"))
    pairs = incoming.join(old, ["supersedes", "entity_id"])
    pairs = pairs.withColumn("_v", arbitrate(text("_f"), F.col("_s"), F.col("_c"), text("valid_from"), F.col("source_type"), F.col("confidence")))
    won = first_of(pairs.where("_v.winner = 'incoming'"), ["supersedes"], [F.col("id")])
    won = won.select(F.col("supersedes").alias("id"), F.col("id").alias("by_id"), F.col("valid_from").alias("_at"), F.col("_v.basis").alias("basis"))
    closed = facts.join(won.select("id", "_at"), "id", "left").withColumn("valid_to", F.coalesce("valid_to", "_at")).select(*facts.columns)
    return closed, won.select("id", "by_id", "basis")


def as_of(facts: DataFrame, at: Column) -> DataFrame:
    """Facts that were valid at a time."""
    return facts.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))
