"""The canonical event table: one row for each event, in the order of `seq` within its session `sid`.

Order is the position in the log; timestamps may be empty. Nested values of free form (tool arguments, instruction lists,
extra fields of scanners) are JSON strings, to be opened with try_parse_json.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import types as T

FORMAT_VERSION = 1

TYPES = ("session_start", "user_message", "assistant_message", "skill_invocation", "tool_result", "compaction", "error", "custom_message")
ROLES = {"user": "user_message", "assistant": "assistant_message", "tool_result": "tool_result"}

STRING, LONG, INT, DOUBLE, BOOLEAN = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


GIT = _struct(branch=STRING, commit=STRING, remote=STRING)
THINKING = _struct(summary=STRING, text=STRING)
TOOL_CALL = _struct(id=STRING, name=STRING, normalized_name=STRING, arguments=STRING)
USAGE = _struct(input=LONG, output=LONG, cache_read=LONG, cache_write=LONG, reasoning_output=LONG, total=LONG, cost_usd=DOUBLE)

#: Columns by the name that a rendered event gives them; the first four are the same for every type.
FIELDS: dict[str, tuple[str, T.DataType]] = {
    "type": ("type", STRING), "id": ("id", STRING), "parentId": ("parent_id", STRING), "timestamp": ("timestamp", STRING),
    "formatVersion": ("format_version", INT), "path": ("path", STRING), "cwd": ("cwd", STRING), "agent": ("agent", STRING), "model": ("model", STRING),
    "git": ("git", GIT), "parentSession": ("parent_session", STRING),
    "text": ("text", STRING), "thinking": ("thinking", THINKING), "toolCalls": ("tool_calls", T.ArrayType(TOOL_CALL)), "provider": ("provider", STRING),
    "stopReason": ("stop_reason", STRING), "usage": ("usage", USAGE),
    "name": ("name", STRING), "arguments": ("arguments", STRING), "sourceEventId": ("source_event_id", STRING),
    "toolCallId": ("tool_call_id", STRING), "toolName": ("tool_name", STRING), "content": ("content", STRING), "isError": ("is_error", BOOLEAN), "exitCode": ("exit_code", INT),
    "summary": ("summary", STRING), "tokensBefore": ("tokens_before", LONG),
    "code": ("code", STRING), "message": ("message", STRING), "retryable": ("retryable", BOOLEAN), "retryAttempt": ("retry_attempt", INT), "maxRetries": ("max_retries", INT),
    "customType": ("custom_type", STRING),
}

EVENT_SCHEMA = _struct(sid=STRING, seq=LONG, **dict(FIELDS.values()), content_json=STRING, extra=STRING)
_USAGE = {"input": "input", "output": "output", "cacheRead": "cache_read", "cacheWrite": "cache_write", "reasoningOutput": "reasoning_output", "total": "total", "costUsd": "cost_usd"}


def dumps(value: Any) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def to_row(event: dict[str, Any], sid: str, seq: int) -> dict[str, Any]:
    """A column for each field of an event as the formats make it."""
    row: dict[str, Any] = dict.fromkeys(EVENT_SCHEMA.names) | {"sid": sid, "seq": seq}
    for field, value in event.items():
        if value is None or field not in FIELDS:
            continue
        column = FIELDS[field][0]
        if field == "usage":
            value = {name: _number(value.get(key), name) for key, name in _USAGE.items()}
        elif field == "git":
            value = {k: value.get(k) for k in ("branch", "commit", "remote")}
        elif field == "thinking":
            value = {k: value.get(k) for k in ("summary", "text")}
        elif field == "toolCalls":
            value = [{"id": c["id"], "name": c["name"], "normalized_name": c.get("normalizedName"), "arguments": dumps(c["arguments"])} for c in value]
        elif field == "arguments":
            value = dumps(value)
        elif field == "content" and not isinstance(value, str):
            column, value = "content_json", dumps(value)
        row[column] = value
    return row


def _number(value: Any, name: str) -> int | float | None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return float(value) if name == "cost_usd" else int(value)
