"""The library's entry points: one log, or many."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import render, sinks
from .operators import context as ctx, joins, select as sel
from .scanners import Scanner
from .sources.logs import local_name, read_logs
from .sources.registry import Registry, default_registry

#: Events of the i-th log are numbered from i * LOG_STEP, so that logs keep their order.
LOG_STEP = 1 << 32


@dataclass(frozen=True)
class Stats:
    sessions_found: int
    sessions_written: int
    events_written: int


def scan_session(spark: SparkSession, path: str, head: str | None = None, source: str | None = None, formats: Iterable[str] = (), criteria: sel.Criteria | None = None, tool_lines: int | None = None, no_thinking: bool = False, block_rows: int | None = None) -> DataFrame:
    """One log's events with their context, filtered and trimmed. A log needs no header here. block_rows: for a log that one task can't hold."""
    registry = default_registry(list(formats))
    events = read_logs(spark, path, source, head, registry, admitted=False)
    kept = sel.filter_events(events, criteria or sel.Criteria(), block_rows)
    return sel.trim(kept, tool_lines, no_thinking) if sel.has_trim(tool_lines, no_thinking) else kept


def views(events: DataFrame, prefix: str = "") -> dict[str, DataFrame]:
    """Views for Spark SQL: events (with context), sessions, turns, tool_calls and tool_results."""
    context = ctx.with_context(events)
    made = {
        "events": context, "sessions": context.where("type = 'session_start'").select("sid", "id", "timestamp", "cwd", "agent", "model", "git", "parent_session", "path"),
        "turns": ctx.turns(context), "tool_calls": joins.calls(context, "run_no", "turn_no"),
        "tool_results": joins.with_call_in_turn(context).where("type = 'tool_result'").select("sid", "seq", "run_no", "turn_no", "tool_call_id", "tool_name", "content", "is_error", "exit_code", "call"),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(prefix + name)
    return made


def read_many(spark: SparkSession, paths: list[str], source: str | None = None, head: str | None = None, registry: Registry | None = None) -> DataFrame:
    """The events of logs in the order in which they are named; a session that goes on in a second log is a second run of it."""
    places = {os.path.abspath(p): i * LOG_STEP for i, p in enumerate(paths)}
    return read_logs(spark, paths, source, head, registry, first_seq=places)


def run(
    spark: SparkSession, paths: Iterable[str], source: str | None = None, head: str | None = None, criteria: sel.Criteria | None = None, scanner: Scanner | None = None, tool_lines: int | None = None, no_thinking: bool = False,
    format: str = "ndjson", out: str | None = None, out_dir: str | None = None, registry: Registry | None = None,
) -> Stats:
    """Read, filter, scan or trim, render and write. What a scanner gives takes the place of the events, after the header."""
    criteria = criteria or sel.Criteria()
    paths = sinks.apart(paths, out, out_dir) if out or out_dir else list(paths)
    events = read_many(spark, [local_name(p) for p in paths], source, head, registry).cache()
    try:
        found = events.where("type = 'session_start'").select("sid").distinct().count()
        kept = sel.filter_events(events, criteria)
        starts, body = kept.where("type = 'session_start'"), kept.where("type != 'session_start'")
        body = scanner(body, starts) if scanner else sel.trim(body, tool_lines, no_thinking)
        rows = starts.unionByName(body, allowMissingColumns=True)
        lines = render.markdown(rows) if format == "md" else render.ndjson(rows).withColumn("line", F.concat("line", F.lit("\n")))
        written = _write(lines, out, out_dir, sinks.EXTENSIONS[format])
        return Stats(found, *written)
    finally:
        events.unpersist()


def _write(lines: DataFrame, out: str | None, out_dir: str | None, extension: str) -> tuple[int, int]:
    """Sessions and events written. One file or stream takes rows partition by partition."""
    seen: set[str] = set()
    n = 0
    if out_dir is None:
        def told():
            for r in lines.select("sid", "seq", "line").orderBy("seq").toLocalIterator():
                seen.add(r["sid"])
                yield r["line"]

        if out is None:
            n = sinks.to_stdout(told())
        else:
            with sinks.open_new(out) as f:
                for line in told():
                    f.write(line)
                    n += 1
        return len(seen), n
    f, at = None, None
    try:
        for r in lines.select("sid", "seq", "line").orderBy("sid", "seq").toLocalIterator():
            if r["sid"] != at:
                if f:
                    f.close()
                at = r["sid"]
                f = sinks.open_new(sinks.session_path(out_dir, at, extension))
                seen.add(at)
            f.write(r["line"])
            n += 1
    finally:
        if f:
            f.close()
    return len(seen), n
