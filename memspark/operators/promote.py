"""Promotion of approved candidates into the trusted tables, each record type by its own fields, with their evidence."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: For each record type the fields of its table, with the names that a payload may have for them, and what stands in their place. A
#: field without a default is required if it is among REQUIRED.
FIELDS: dict[str, dict[str, tuple[tuple[str, ...], str | None]]] = {
    "entity": {"name": (("name", "title"), None), "entity_type": (("entity_type",), "concept"), "content": (("observe", "content"), None), "category": (("category",), "general")},
    "observation": {"name": (("entity_name", "name", "title"), None), "content": (("content", "observe"), None), "entity_type": (("entity_type",), "concept"), "category": (("category",), "general"), "supersedes": (("supersedes",), None)},
    "decision": {"title": (("title",), None), "reasoning": (("reasoning", "content"), None), "supersedes": (("supersedes",), None)},
    "context": {"key": (("key", "id"), None), "title": (("title",), None), "category": (("category",), "reference"), "content": (("content", "body"), None)},
    "state": {"key": (("key", "id"), None), "title": (("title",), None), "status": (("status",), "needs-review"), "owner": (("owner",), None), "details": (("details", "content"), None), "priority": (("priority",), "medium")},
}
REQUIRED = {"entity": ("name",), "observation": ("name", "content"), "decision": ("title",), "context": ("key", "title", "content"), "state": ("key", "title")}


class Promotion(NamedTuple):
    """``tables``: id, candidate_id, scope and the fields of each record type; ``failed``: id, error; ``evidence``: with trusted_record_type and trusted_record_id."""

    tables: dict[str, DataFrame]
    failed: DataFrame
    evidence: DataFrame


def _field(payload: Column, names: tuple[str, ...], default: str | None) -> Column:
    """The first of ``names`` that holds a text, a number or a truth value; lists and objects count as missing."""
    raw = lambda n: F.try_variant_get(payload, f"$.{n}", "variant")
    plain = lambda n: F.when(~F.schema_of_variant(raw(n)).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(payload, f"$.{n}", "string"))
    return F.coalesce(*map(plain, names), F.lit(default))


def promote(candidates: DataFrame, evidence: DataFrame) -> Promotion:
    """Approved ``candidates`` (id, record_type, scope, payload) as rows of the trusted tables, and ``evidence`` (candidate_id, ...) pointing to them.

    A record's id is the key of its payload, or a hash of the candidate's id, so reruns agree. Candidates without a required field, and those
    of another record type, fail and keep their evidence as it is. Of several candidates of a key each is a row; the table's upsert decides. A
    payload that doesn't parse has no fields.
    """
    parsed = candidates.select("id", F.lower(F.trim("record_type")).alias("record_type"), "scope", F.try_parse_json("payload").alias("_p"))
    tables, missing, places = {}, None, None
    for kind, fields in FIELDS.items():
        row = parsed.where(F.col("record_type") == kind).select(F.col("id").alias("candidate_id"), "scope", *[_field(F.col("_p"), *how).alias(f) for f, how in fields.items()])
        lacks = None
        for f in REQUIRED[kind]:
            text = F.lit("candidate payload missing required field: " + "|".join(fields[f][0]))
            lacks = F.when(F.coalesce(F.trim(f), F.lit("")) == "", text) if lacks is None else lacks.when(F.coalesce(F.trim(f), F.lit("")) == "", text)
        row = row.withColumn("error", lacks)
        id_ = F.col("key") if "key" in fields else F.substring(F.sha2(F.concat_ws("\u001f", F.lit(kind), F.col("candidate_id").cast("string")), 256), 1, 26)
        tables[kind] = row.where("error IS NULL").select(id_.alias("id"), "candidate_id", "scope", *fields)
        wrong = row.where("error IS NOT NULL").select(F.col("candidate_id").alias("id"), "error")
        place = tables[kind].select("candidate_id", F.lit(kind).alias("_type"), F.col("id").alias("_id"))
        missing, places = (wrong, place) if missing is None else (missing.unionByName(wrong), places.unionByName(place))
    other = parsed.where(~F.coalesce(F.col("record_type").isin(*FIELDS), F.lit(False))).select("id", F.concat(F.lit("invalid record type: "), F.coalesce("record_type", F.lit(""))).alias("error"))
    pointed = evidence.join(places, "candidate_id", "left")
    for column, value in (("trusted_record_type", "_type"), ("trusted_record_id", "_id")):
        pointed = pointed.withColumn(column, F.coalesce(value, F.col(column) if column in evidence.columns else F.lit(None).cast("string")))
    return Promotion(tables, missing.unionByName(other), pointed.drop("_type", "_id"))
