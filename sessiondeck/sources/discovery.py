"""Finding logs: dates and folders are checked on names, before any file is opened."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

from .formats.base import Format
from .json_values import read_first_value
from .registry import Registry


@dataclass(frozen=True)
class Search:
    """cwd: part of the working folder, in any case. Names' dates count by day, both ends included; else the file's own time counts to the instant."""

    sessions_dir: str | None = None
    cwd: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    include_subagents: bool = False
    source: str | None = None


def discover(registry: Registry, search: Search) -> Iterator[str]:
    chosen = registry.all() if search.source is None else [x for x in [registry.get(search.source)] if x]
    for known in chosen:
        own = getattr(known, "discover", None)
        yield from own(search) if callable(own) else walk(known, search.sessions_dir or known.folder(), search)


def walk(known: Format, root: str, search: Search, depth: int = 0) -> Iterator[str]:
    try:
        entries = sorted(os.scandir(root), key=lambda e: e.name)
    except OSError:
        return
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            if known.layout.recursive or depth == 0 or (search.include_subagents and e.name == "subagents"):
                yield from walk(known, e.path, search, depth + 1)
        elif known.layout.match(e.name) and in_time(known, e, search) and in_folder(known, e.path, search):
            yield e.path


def in_time(known: Format, entry: os.DirEntry, search: Search) -> bool:
    if not search.since and not search.until:
        return True
    day = known.layout.date_of(entry.name) if known.layout.date_of else None
    if day:
        low, high = ((x.astimezone(timezone.utc).strftime("%Y-%m-%d") if x else None) for x in (search.since, search.until))
        return (low is None or day >= low) and (high is None or day <= high)
    try:
        at = datetime.fromtimestamp(entry.stat().st_mtime, timezone.utc)
    except OSError:
        return False
    return (not search.since or at >= search.since) and (not search.until or at <= search.until)


def in_folder(known: Format, path: str, search: Search) -> bool:
    if not search.cwd or not known.layout.cwd_of:
        return True
    with open(path, encoding="utf-8", errors="replace") as f:
        first = read_first_value(f)
    return search.cwd.lower() in known.layout.cwd_of(first, os.path.basename(os.path.dirname(path))).lower()
