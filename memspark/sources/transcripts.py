"""Transcript sources: JSON lines, JSON documents and plain text, as rows of (source, idx, role, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions.text import role

# The keys of roles, texts and lists in transcripts.
ROLE_KEYS, TEXT_KEYS = ("role", "author", "speaker", "type"), ("content", "text", "message", "body")
LIST_KEYS = ("messages", "conversation", "items", "events", "history", "turns")


def _first(x: str, keys: tuple[str, ...]):
    return F.coalesce(*[F.get_json_object(x, f"$.{k}") for k in keys])


def nested_text(x: Column) -> Column:
    """The text of a message's content: a text as it is, of an object its text or content, of a list those of its items, a line each."""
    of = lambda o: F.coalesce(F.get_json_object(o, "$.text"), F.get_json_object(o, "$.content"))
    item = lambda o: F.when(F.startswith(F.ltrim(o), F.lit("{")), of(o)).otherwise(o)
    items = F.filter(F.transform(F.from_json(x, "array<string>"), item), lambda t: t.isNotNull() & (F.trim(t) != ""))
    listed = F.startswith(F.ltrim(x), F.lit("[")) & F.try_parse_json(x).isNotNull()
    return F.when(listed, F.array_join(items, "\n")).when(F.startswith(F.ltrim(x), F.lit("{")) & F.try_parse_json(x).isNotNull(), of(x)).otherwise(x)


def parse_jsonl(lines: DataFrame) -> DataFrame:
    """source, idx, role, text of JSON lines (source, idx, value); lines that don't parse or hold no text drop out.

    Shapes: event messages (type event_msg with a payload), messages (message with role and content), and generic ones
    with a role and a text under one of ROLE_KEYS and TEXT_KEYS.
    """
    parsed = lines.where(F.try_parse_json("value").isNotNull())
    at = lambda path: F.get_json_object("value", f"$.{path}")
    event = at("type") == "event_msg"
    kind = F.when(event, at("payload.type"))
    said = F.when(kind.isin("user_message", "agent_message"), at("payload.message")).when(kind == "task_complete", at("payload.last_agent_message"))
    message = F.when(event, said).otherwise(F.coalesce(at("message.content"), at("payload.message"), _first("value", TEXT_KEYS)))
    who = F.when(event, F.when(kind == "user_message", "user").otherwise("assistant")).otherwise(F.coalesce(at("message.role"), _first("value", ROLE_KEYS), F.lit("unknown")))
    out = parsed.select("source", "idx", role(who).alias("role"), F.trim(nested_text(message)).alias("text"))
    return out.where(F.col("text") != "")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """:func:`parse_jsonl` over files; a line's idx is its place among its file's lines that Spark reads in one split."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.monotonically_increasing_id().alias("idx"), "value")
    return parse_jsonl(lines)


def parse_json(documents: DataFrame, depth: int = 4) -> DataFrame:
    """source, idx, role, text of whole JSON documents (source, value): events of a list, or of the list that an object has under one of LIST_KEYS.

    Lists inside lists are followed ``depth`` deep; idx numbers the events of a source in their order.
    """
    lists = F.coalesce(*[F.from_json(F.get_json_object("value", f"$.{k}"), "array<string>") for k in LIST_KEYS], F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", "array<string>")))
    rows, events = documents.where(F.try_parse_json("value").isNotNull()).select("source", F.array().cast("array<int>").alias("_path"), "value"), None
    for level in range(depth):
        listed = rows.withColumn("_list", lists)
        single = listed.where("_list IS NULL").select("source", "_path", "value")
        if level:
            events = single if events is None else events.unionByName(single)
        rows = listed.select("source", "_path", F.posexplode("_list").alias("_i", "value")).select("source", F.concat("_path", F.array("_i")).alias("_path"), "value")
    events = events.unionByName(rows)
    number = F.row_number().over(Window.partitionBy("source").orderBy("_path")) - 1
    return parse_jsonl(events.select("source", number.alias("idx"), "value"))


def parse_text(documents: DataFrame) -> DataFrame:
    """source, idx, role, text of plain texts (source, value): chunks between blank lines, with an optional "role:" before."""
    chunk = documents.select("source", F.posexplode(F.split("value", r"\n[ \t]*\n+")).alias("idx", "chunk")).withColumn("chunk", F.trim("chunk")).where("chunk <> ''")
    prefix = F.regexp_extract("chunk", r"(?i)^(user|human|assistant|ai|system|tool):", 1)
    body = F.trim(F.regexp_replace("chunk", r"(?i)^(user|human|assistant|ai|system|tool):\s*", ""))
    return chunk.select("source", "idx", F.when(prefix == "", "unknown").otherwise(role(prefix)).alias("role"), body.alias("text"))


def parse_git_status(snapshots: DataFrame) -> DataFrame:
    """id, changed, staged, unstaged, untracked of porcelain status texts (id, value): lists in order, first seen only; a rename counts as its new name."""
    line = snapshots.select("id", F.posexplode(F.split("value", "\n")).alias("n", "l")).where(F.length("l") > 3)
    path = F.regexp_replace(F.trim(F.substring("l", 4, 1_000_000)), '^.* -> |"', "")
    line = line.select("id", "n", F.substring("l", 1, 1).alias("x"), F.substring("l", 2, 1).alias("y"), path.alias("path"))
    new = (F.col("x") == "?") & (F.col("y") == "?")
    names = lambda when: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("n", "path")))), lambda s: s["path"]))
    return line.groupBy("id").agg(names(F.lit(True)).alias("changed"), names(~new & (F.col("x") != " ")).alias("staged"), names(~new & (F.col("y") != " ")).alias("unstaged"), names(new).alias("untracked"))


def blocked(paths: DataFrame, blocks: DataFrame) -> DataFrame:
    """``paths`` (path, ...) that no ``blocks`` (prefix) name: a path is blocked if it is the block, lies under it, or holds it as a part between slashes.

    The blocks are a configuration: a handful of rows.
    """
    b = F.broadcast(blocks)
    hit = (F.col("path") == F.col("prefix")) | F.startswith("path", F.concat("prefix", F.lit("/"))) | F.contains(F.col("path"), F.concat(F.lit("/"), F.col("prefix"), F.lit("/")))
    return paths.join(b, hit, "left_anti")
