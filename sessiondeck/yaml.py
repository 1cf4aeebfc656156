"""A small YAML emitter for the bodies of transcripts."""

from __future__ import annotations

import json
import re
from typing import Any

from .schema import dumps
from .sources.formats.base import string

_RESERVED = re.compile(r"(true|false|null|yes|no|on|off|~)\Z", re.I)
_INDICATOR = re.compile(r"[-?:,\[\]{}#&*!|>'\"%@`]")


def _numeric(s: str) -> bool:
    if not re.fullmatch(r"[0-9.+-]+", s):
        return False
    try:
        float(s)
    except ValueError:
        return False
    return True


def scalar(value: Any) -> str:
    if not isinstance(value, str):
        return string(value)
    plain = value and value == value.strip() and not _RESERVED.match(value) and not _INDICATOR.match(value) and ": " not in value and " #" not in value and not _numeric(value)
    return value if plain else dumps(value)


def _literal(text: str, depth: int) -> str:
    """A text of several lines, without empty ones at either end."""
    lines = re.sub(r"\n+\Z", "", re.sub(r"\A\n+", "", text)).split("\n")
    return "\n".join(["|-", *(f"{'  ' * depth}{x}" if x else "" for x in lines)])


def _value(value: Any, depth: int) -> str:
    return _literal(value, depth) if isinstance(value, str) and "\n" in value else scalar(value)


def mapping(value: dict[str, Any], depth: int = 0) -> str:
    pad, out = "  " * depth, []
    for key, v in value.items():
        if isinstance(v, dict):
            out.append(f"{pad}{key}:\n{mapping(v, depth + 1)}")
        elif isinstance(v, list) and v:
            out.append("\n".join([f"{pad}{key}:", *(_item(x, depth + 1) for x in v)]))
        else:
            out.append(f"{pad}{key}: {'[]' if isinstance(v, list) else _value(v, depth + 1)}")
    return "\n".join(out)


def _item(value: Any, depth: int) -> str:
    pad = "  " * depth
    if isinstance(value, dict):
        return f"{pad}- {mapping(value, depth + 1)[len(pad) + 2 :]}"
    return f"{pad}- {dumps(value) if isinstance(value, list) else _value(value, depth + 1)}"


def from_json(text: str | None) -> str | None:
    """An object as JSON to YAML; other values as one scalar."""
    if text is None:
        return None
    value = json.loads(text)
    return mapping(value) if isinstance(value, dict) else _value(value, 1)
