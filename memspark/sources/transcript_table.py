"""Transcripts in SQL: a table function that reads the raw text of an agent's file, for use with LATERAL."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from memspark.sources.transcripts import LIST_KEYS, ROLE_KEYS, TEXT_KEYS

_ROLES = {"human": "user", "user": "user", "ai": "assistant", "assistant": "assistant", "model": "assistant", "agent": "assistant"}
_SPOKEN = re.compile(r"(user|human|assistant|ai|system|tool):\s*", re.I)


def _plain(value: object) -> str:
    """The text of a message's content: a text, an object's text or content, or those of a list's items, a line each."""
    if isinstance(value, list):
        return "\n".join(t for t in map(_plain, value) if t.strip())
    if isinstance(value, dict):
        return _plain(next((value[k] for k in ("text", "content") if value.get(k) is not None), ""))
    return value if isinstance(value, str) else "" if value is None else json.dumps(value)


def _first(value: dict, keys: tuple[str, ...]) -> object:
    return next((value[k] for k in keys if value.get(k) is not None), None)


def _message(value: object) -> tuple[str, str, str, str | None] | None:
    """(role, kind, text, time) of an event; None if it isn't a message."""
    if not isinstance(value, dict):
        return None
    time = _first(value, ("timestamp", "created_at", "time"))
    time = None if time is None else str(time)
    payload = value.get("payload") if isinstance(value.get("payload"), dict) else {}
    if value.get("type") == "event_msg":
        kind = payload.get("type")
        text = payload.get("last_agent_message") if kind == "task_complete" else payload.get("message") if kind in ("user_message", "agent_message") else None
        return None if text is None else ("user" if kind == "user_message" else "assistant", str(kind), _plain(text).strip(), time)
    inner = value.get("message") if isinstance(value.get("message"), dict) else {}
    text = next((t for t in (inner.get("content"), payload.get("message"), _first(value, TEXT_KEYS)) if t is not None), None)
    who = next((r for r in (inner.get("role"), _first(value, ROLE_KEYS)) if r is not None), "unknown")
    who = str(who).strip().lower()
    return None if text is None else (_ROLES.get(who, who), str(value.get("type") or "message"), _plain(text).strip(), time)


def _events(value: object, depth: int = 4) -> Iterator[object]:
    """The events of a document: those of a list, or of the list that an object has under one of LIST_KEYS."""
    listed = value if isinstance(value, list) else next((value[k] for k in LIST_KEYS if isinstance(value.get(k), list)), None) if isinstance(value, dict) else None
    if listed is None or not depth:
        yield value
    else:
        for item in listed:
            yield from _events(item, depth - 1)


@udtf(returnType="idx int, role string, kind string, text string, ts string")
class ParseTranscript:
    """idx, role, kind, text, ts of the messages of a raw transcript: JSON lines (codex, claude), a JSON document, or plain text for other agents.

    Lines that don't parse, and events without text, drop out; idx numbers what is left. A null or empty text gives no row.
    """

    def eval(self, agent: str, raw: str):
        n = 0
        if not raw or not raw.strip():
            return
        body = raw.strip()
        found: Iterator[tuple[str, str, str, str | None] | None]
        if agent in ("codex", "claude"):
            found = (_message(v) for line in body.split("\n") for v in self._parsed(line))
        elif body[0] in "[{" and (whole := list(self._parsed(body))):
            found = (_message(v) for v in _events(whole[0]))
        else:
            found = map(self._spoken, (c.strip() for c in re.split(r"\n[ \t]*\n+", body)))
        for message in found:
            if message is not None and message[2]:
                yield n, *message
                n += 1

    @staticmethod
    def _parsed(line: str) -> list[object]:
        try:
            return [json.loads(line)]
        except ValueError:
            return []

    @staticmethod
    def _spoken(chunk: str) -> tuple[str, str, str, str | None]:
        m = _SPOKEN.match(chunk)
        who = m[1].lower() if m else "unknown"
        return _ROLES.get(who, who), "text", chunk[m.end() :].strip() if m else chunk, None


def register(spark: SparkSession, name: str = "parse_transcript") -> None:
    """Makes the function known to the session's SQL."""
    spark.udtf.register(name, ParseTranscript)
