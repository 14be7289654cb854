"""Write commands over whole tables: proposals, edits, saves and the maintenance of records, with the events they emit."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import enums, text
from memspark.operators.changes import emitted, patch, upsert_latest
from memspark.operators.redact import redacted, redacted_json
from memspark.operators.stored import spread

EVIDENCE_CHARACTERS = 800


def _object(payload: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(F.startswith(F.ltrim(payload), F.lit("{")) & F.try_parse_json(payload).isNotNull(), F.lit(False))


def propose(proposals: DataFrame, evidence: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, evidence links, quarantined) of ``proposals`` (id, source_type, source, record_type, payload, scope, confidence, rationale).

    Record type, source type, scope, confidence and payload (a JSON object) are checked; what breaks a rule is quarantined
    with ``errors``. Payloads are redacted key by key, rationales as text. ``evidence`` (candidate_id, source_event_id,
    source_type, source, title, excerpt) of valid candidates is linked, excerpts compacted.
    """
    folded = proposals.withColumn("record_type", enums.folded(F.col("record_type"))).withColumn("source_type", F.trim("source_type"))
    rules = {
        "record_type": enums.RECORD_TYPE, "source_type": F.col("source_type") != "", "scope": text.valid_scope(F.col("scope")),
        "confidence": enums.in_unit(F.col("confidence")), "payload": _object(F.col("payload")),
    }
    valid, wrong = enums.split_valid(folded, rules)
    valid = valid.withColumns({"payload": redacted_json("payload"), "rationale": redacted(F.col("rationale"))["text"], "status": F.lit("pending")})
    links = None
    if evidence is not None:
        links = evidence.join(valid.select(F.col("id").alias("candidate_id")), "candidate_id", "left_semi").withColumn("excerpt", text.compact(F.col("excerpt"), EVIDENCE_CHARACTERS))
    return valid, links, wrong


def edit(candidates: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with their ``edits``, failed: id, place, error).

    ``edits`` (id, place, record_type, payload, scope, confidence, rationale) give the fields that change, null for those
    that stay; several edits of a candidate apply in order of place. An edit fails whole if its candidate is missing or
    not pending, or if a field that it gives is not allowed.
    """
    known = candidates.select("id", F.col("status").alias("_status"))
    given = edits.withColumn("record_type", F.when(F.trim("record_type") != "", enums.folded(F.col("record_type")))).join(known, "id", "left")
    allowed = lambda c, rule: F.col(c).isNull() | rule
    error = (
        F.when(F.col("_status").isNull(), "not found").when(F.col("_status") != "pending", F.concat(F.lit("already "), "_status"))
        .when(~allowed("record_type", F.col("record_type").isin(*enums.RECORD_TYPE)), "record_type").when(~allowed("payload", _object(F.col("payload"))), "payload")
        .when(~allowed("scope", text.valid_scope(F.col("scope"))), "scope").when(~allowed("confidence", enums.in_unit(F.col("confidence"))), "confidence")
    )
    given = given.withColumn("error", error)
    fields = [c for c in ("record_type", "payload", "scope", "confidence", "rationale") if c in candidates.columns]
    return patch(candidates, given.where("error IS NULL"), "id", fields, "place"), given.where("error IS NOT NULL").select("id", "place", "error")


def save_entities(entities: DataFrame, observations: DataFrame, relations: DataFrame, commands: DataFrame, at: Column) -> dict[str, DataFrame]:
    """New ``entities``, ``observations``, ``relations``, the ``events`` of a batch of save ``commands``, and those ``rejected``.

    A command (place, name, entity_type, category, scope, observe, relate, session) saves an entity under the slug of its
    name, an observation if it has one, and a relation ("target:type") to an entity that exists or that the same batch
    saves. The last command of an entity gives its row, its first one decides whether it counts as created. A command that
    breaks an enum, a scope or a relation is rejected whole.
    """
    c = commands.withColumns({"entity_id": text.slugify(F.col("name")), "name": F.trim("name"), "_r": text.relation_spec(F.col("relate"))})
    rules = {
        "entity_type": enums.ENTITY_TYPE, "category": enums.OBSERVATION_CATEGORY, "scope": text.valid_scope(F.col("scope")), "name": F.col("entity_id") != "",
        "relate": F.col("relate").isNull() | F.col("_r").isNotNull(),
    }
    c, wrong = enums.split_valid(c.withColumn("_target", text.slugify(F.col("_r.target"))), rules)
    ids = entities.select("id").unionByName(c.select(F.col("entity_id").alias("id"))).distinct().withColumn("_known", F.lit(True))
    # commands without a target meet nothing, each in the partition of its own entity instead of all in that of null
    n, alone = commands.count(), F.concat(F.lit("\u0000"), "entity_id")
    c = spread(c.withColumn("_key", F.coalesce("_target", alone)), n, "_key").join(ids.withColumnRenamed("id", "_key"), "_key", "left").drop("_key")
    lost = F.col("_target").isNotNull() & F.col("_known").isNull()
    rejected = wrong.select("place", "errors").unionByName(c.where(lost).select("place", F.array(F.lit("entity not found")).alias("errors")))
    c = spread(c.where(~lost), n, "entity_id")
    source = F.when(F.col("session").isNotNull(), F.concat(F.lit("session:"), "session"))
    mark = lambda *parts: F.substring(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 26)
    order = F.col("place").desc()
    new = upsert_latest(entities, c.select(F.col("entity_id").alias("id"), "name", "entity_type", "scope", at.alias("created_at"), at.alias("updated_at"), "place"), ["id"], [order], keep=("created_at",))
    said = c.where("observe IS NOT NULL").select(
        mark(F.lit("observation"), F.col("entity_id"), F.col("place").cast("string")).alias("id"), "entity_id", F.trim("observe").alias("content"), "category", source.alias("source"), "scope", "place"
    )
    tied = c.where("_target IS NOT NULL").select(
        mark(F.lit("relation"), F.col("entity_id"), F.col("_target"), F.col("_r.relation")).alias("id"), F.col("entity_id").alias("from_entity"), F.col("_target").alias("to_entity"),
        F.col("_r.relation").alias("relation"), source.alias("source"), F.lit(None).cast("timestamp").alias("valid_to"), "scope", "place",
    )
    first = Window.partitionBy("entity_id").orderBy("place")
    seen = c.join(entities.select(F.col("id").alias("entity_id"), F.lit(True).alias("_was")), "entity_id", "left")
    seen = seen.withColumn("kind", F.when(F.col("_was").isNotNull() | (F.row_number().over(first) > 1), "entity_updated").otherwise("entity_created"))
    events = emitted(seen, F.col("kind"), F.concat_ws("@", "entity_id", F.col("place").cast("string")), at)
    events = events.unionByName(emitted(said, F.lit("observation_added"), F.col("id"), at)).unionByName(emitted(tied, F.lit("relation_created"), F.concat_ws("@", "id", F.col("place").cast("string")), at))
    return {
        "entities": new, "observations": observations.unionByName(said.select(*observations.columns)), "events": events, "rejected": rejected,
        "relations": upsert_latest(relations, tied, ["from_entity", "to_entity", "relation"], [order], keep=("id",)),
    }


class Rules(NamedTuple):
    """How a table takes commands: its key, the fields that may change, checks, columns of arrays, a version and its event's name."""

    key: str
    fields: list[str]
    checks: dict
    event: str
    version: str | None = None
    checksum: tuple[str, str] | None = None


def apply_commands(base: DataFrame, commands: DataFrame, rules: Rules, at: Column) -> dict[str, DataFrame]:
    """``table`` after ``commands`` (key, place, action: put, update or delete, and fields), ``events``, and those ``rejected``.

    Commands of a key act in order of place, by what stands before each: update and delete need a row, put makes or
    replaces one (created_at stays), update changes the fields that aren't null. A command that breaks a check on a field
    that it gives, or that finds no row, is rejected and changes nothing. ``version`` grows by one for each change of a row
    that stays, and ``checksum`` (column, of column) is the SHA-256 of the trimmed text.
    """
    key = rules.key
    given = lambda n, rule: F.col(n).isNull() | (rule if isinstance(rule, Column) else F.col(n).isin(*rule))
    ok, wrong = enums.split_valid(commands, {"action": ["put", "update", "delete"]} | {n: given(n, r) for n, r in rules.checks.items()})
    there = base.select(key, F.lit(True).alias("_there"))
    before = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    # a row is there if the last put or delete before left it there; updates don't change that
    makes = F.when(F.col("action") == "put", True).when(F.col("action") == "delete", False)
    ok = ok.join(there, key, "left").withColumn("_makes", makes).withColumn("_there", F.coalesce(F.last("_makes", True).over(before), "_there", F.lit(False)))
    lost = ok.where("action <> 'put' AND NOT _there").withColumn("errors", F.array(F.lit("not found")))
    ok = ok.where("action = 'put' OR _there").withColumn("_start", F.max(F.when(F.col("action").isin("put", "delete"), F.col("place"))).over(until))
    latest = F.max("_start").over(Window.partitionBy(key))
    # what happened since the last put or delete decides; a put gives all fields, updates after it some
    tail = ok.withColumn("_latest", latest).where("_latest IS NULL OR place >= _latest")
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(f"_f_{c}") for c in rules.fields]
    after = tail.groupBy(key).agg(*last, F.max(F.col("action") == "put").alias("_put"), F.max(F.col("action") == "delete").alias("_gone"))
    changed = ok.where("action <> 'delete'").groupBy(key).agg(F.count("*").alias("_times"))
    both = base.join(after.join(changed, key, "left"), key, "full").where("NOT coalesce(_gone, false)")
    fields = {c: F.when(F.col("_put"), F.col(f"_f_{c}")).otherwise(F.coalesce(f"_f_{c}", c)) for c in rules.fields}
    if "created_at" in base.columns:
        fields["created_at"] = F.coalesce("created_at", at)
    if "updated_at" in base.columns:
        fields["updated_at"] = F.when(F.col("_times").isNotNull(), at).otherwise(F.col("updated_at"))
    if rules.version:
        fields[rules.version] = F.when(F.col(rules.version).isNull(), F.coalesce("_times", F.lit(1))).otherwise(F.col(rules.version) + F.coalesce("_times", F.lit(0))).cast(base.schema[rules.version].dataType)
    out = both.withColumns(fields)
    if rules.checksum:
        out = out.withColumn(rules.checksum[0], F.sha2(F.trim(rules.checksum[1]), 256))
    kind = F.concat(F.lit(rules.event + "_"), F.when(F.col("action") == "delete", "deleted").when(F.col("_there"), "updated").otherwise("created"))
    events = emitted(ok, kind, F.concat_ws("@", F.col(key).cast("string"), F.col("place").cast("string")), at)
    return {"table": out.select(*base.columns), "events": events, "rejected": wrong.select(key, "place", "errors").unionByName(lost.select(key, "place", "errors"))}


def record_rules(table: str) -> Rules:
    """The rules of state, context, decisions, sessions, entities, observations or relations."""
    scope = {"scope": text.valid_scope(F.col("scope"))}
    return {
        "state": lambda: Rules("key", ["title", "status", "owner", "details", "scope", "priority"], {"status": enums.STATE_STATUS, "priority": enums.STATE_PRIORITY, **scope}, "state"),
        "context": lambda: Rules("key", ["title", "content", "category", "scope"], {"category": enums.CONTEXT_CATEGORY, **scope}, "context", "version", ("checksum", "content")),
        "decisions": lambda: Rules("id", ["title", "reasoning", "scope", "status"], {"status": enums.DECISION_STATUS, **scope}, "decision"),
        "sessions": lambda: Rules("id", ["session_type", "scope", "status", "goal", "summary"], {"status": enums.SESSION_STATUS, "session_type": enums.SESSION_TYPE, **scope}, "session"),
        "entities": lambda: Rules("id", ["name", "entity_type", "scope"], {"entity_type": enums.ENTITY_TYPE, **scope}, "entity"),
        "observations": lambda: Rules("id", ["content", "category"], {"category": enums.OBSERVATION_CATEGORY}, "observation"),
        "relations": lambda: Rules("id", ["relation", "weight"], {"relation": enums.RELATION}, "relation"),
    }[table]()
