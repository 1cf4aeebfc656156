"""What a log format has to tell, and small helpers for values from JavaScript writers."""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

from ...schema import dumps

Event = dict[str, Any]


@dataclass(frozen=True)
class Layout:
    """How a format's logs lie below its folder: folder/<dir>/<file>, or at any depth."""

    match: Callable[[str], bool]
    recursive: bool = False
    date_of: Callable[[str], str | None] | None = None
    cwd_of: Callable[[Any, str], str] | None = None


class Format:
    """A source of events. Subclasses give `name`, `layout`, `detect` and `parse`, and `head` if branches can be selected."""

    name: str = ""
    layout: Layout
    #: Whether parse() also takes a text in parts, as an iterator.
    in_parts: bool = False
    tool_names: dict[str, str] | None = None

    def folder(self) -> str:
        raise NotImplementedError

    def detect(self, first: Any, text: str) -> bool:
        """first: the first JSON value, or None."""
        raise NotImplementedError

    def parse(self, text: str, path: str) -> Iterator[Event]:
        raise NotImplementedError

    head: Callable[[str, str, str], Iterator[Event]] | None = None

    def normalize(self, tool: str, arguments: dict[str, Any]) -> str:
        return (self.tool_names or {}).get(tool, tool)


def home(*parts: str) -> str:
    return os.path.join(os.path.expanduser("~"), *parts)


def string(value: Any) -> str:
    """A value as its writer's language would print it."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    if isinstance(value, float):
        return str(int(value)) if math.isfinite(value) and value == int(value) and abs(value) < 1e21 else repr(value)
    if isinstance(value, (list, tuple)):
        return ",".join("" if x is None else string(x) for x in value)
    return "[object Object]" if isinstance(value, dict) else str(value)


def first_set(*values: Any) -> Any:
    """The first that isn't None."""
    return next((x for x in values if x is not None), None)


def record(value: Any) -> dict[str, Any]:
    return value if isinstance(value, dict) else {}


def number(value: Any) -> int | float | None:
    return value if isinstance(value, (int, float)) and not isinstance(value, bool) else None


def joined_text(content: Any, typed: bool = True) -> str:
    """A string, or the texts of blocks by lines; typed: of blocks of type text only."""
    if isinstance(content, str):
        return content
    if not isinstance(content, list):
        return ""
    blocks = (record(b) for b in content)
    return "\n".join(b["text"] for b in blocks if isinstance(b.get("text"), str) and (not typed or b.get("type") == "text"))


def block_text(content: Any) -> str:
    """A tool's output: a string, the texts of blocks joined without a gap (others as JSON), or JSON."""
    if isinstance(content, str):
        return content
    if isinstance(content, list):
        return "".join(b["text"] if isinstance(record(b).get("text"), str) else dumps(b) for b in content)
    return "" if content is None else dumps(content)


def skill_of(arguments: Any, names: Iterable[str], located: bool) -> Event | None:
    """name, path and the other arguments of a call of the skill tool; names: the argument that names the skill, first that is set."""
    if not isinstance(arguments, dict):
        return None
    rest = dict(arguments)
    name = first_set(*[rest.pop(k, None) for k in names])
    if not isinstance(name, str) or not name:
        return None
    found: Event = {"name": name}
    if located:
        places = [rest.pop(k, None) for k in ("path", "location")]
        path = next((x for x in places if isinstance(x, str)), None)
        if path:
            found["path"] = path
    if rest:
        found["arguments"] = rest
    return found


class HeadError(ValueError):
    pass


def ancestry(entries: list[dict[str, Any]], head: str) -> list[dict[str, Any]]:
    """The entries from the root to `head`, in the order of the log. Entries have `id` and `parentId`; a parent that isn't there ends the path."""
    if not head.strip():
        raise HeadError("head ID must not be empty")
    by_id: dict[str, dict[str, Any]] = {}
    for e in entries:
        if by_id.setdefault(e["id"], e) is not e:
            raise HeadError(f'duplicate entry ID "{e["id"]}"')
    if head not in by_id:
        raise HeadError(f'head "{head}" was not found')
    chosen: set[str] = set()
    at: str | None = head
    while at is not None and at in by_id:
        if at in chosen:
            raise HeadError(f'cycle at entry "{at}"')
        chosen.add(at)
        at = by_id[at]["parentId"]
    return [e for e in entries if e["id"] in chosen]
