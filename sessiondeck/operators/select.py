"""Which sessions, turns, branches and events."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import ROLES, TYPES
from ..shared import shared_dir
from . import joins
from .context import with_context

MAX_SAFE = 2**53 - 1


@dataclass(frozen=True)
class Criteria:
    """All that are set must hold; of a list, one. skills and last_turns choose sessions and turns before the others choose events."""

    skills: tuple[str, ...] | None = None
    last_turns: int | None = None
    types: tuple[str, ...] | None = None
    roles: tuple[str, ...] | None = None
    tools: tuple[str, ...] | None = None
    error: bool = False
    tool_results: str | None = None

    def __post_init__(self) -> None:
        if self.last_turns is not None and not (isinstance(self.last_turns, int) and not isinstance(self.last_turns, bool) and 0 < self.last_turns <= MAX_SAFE):
            raise ValueError("last_turns must be a positive integer")
        if bad := set(self.types or ()) - set(TYPES):
            raise ValueError(f"unknown types: {sorted(bad)}")
        if bad := set(self.roles or ()) - set(ROLES):
            raise ValueError(f"unknown roles: {sorted(bad)}")
        if self.tool_results not in (None, "all", "errors"):
            raise ValueError('tool_results must be "all" or "errors"')

    def any(self) -> bool:
        return bool(self.skills or self.last_turns or self.types or self.roles or self.tools or self.error or self.tool_results == "errors")


def by_skill(events: DataFrame, names: Iterable[str]) -> DataFrame:
    """All events of the sessions in which one of the skills was invoked; all sessions if none is named."""
    wanted = list(names)
    if not wanted:
        return events
    found = events.where((F.col("type") == "skill_invocation") & F.col("name").isin(wanted)).select("sid").distinct()
    return events.join(found, "sid", "left_semi")


def last_turns(context: DataFrame, n: int) -> DataFrame:
    """Headers and the last n turns of each run; what comes before the first turn goes."""
    Criteria(last_turns=n)
    last = F.max("turn_no").over(Window.partitionBy("sid", "run_no"))
    return context.withColumn("_last", last).where((F.col("type") == "session_start") | ((F.col("turn_no") > 0) & (F.col("turn_no") > F.col("_last") - n))).drop("_last")


def event_filter(c: Criteria) -> Column:
    """The criteria that look at one event; `called_name` is the name of a result's call."""
    keep = F.lit(True)
    kind = F.col("type")
    if c.types:
        keep = keep & kind.isin(list(c.types))
    if c.roles:
        keep = keep & kind.isin([ROLES[r] for r in c.roles])
    is_result = kind == "tool_result"
    failed = F.coalesce(F.col("is_error"), F.lit(False))
    if c.error:
        keep = keep & is_result & failed
    if c.tool_results == "errors":
        keep = keep & ~(is_result & ~failed)
    if c.tools:
        names = list(c.tools)
        called = F.exists("tool_calls", lambda x: F.coalesce(x["normalized_name"], x["name"]).isin(names))
        of_result = F.coalesce(F.col("called_name"), F.col("tool_name")).isin(names)
        keep = keep & F.coalesce(F.when(kind == "assistant_message", called).when(is_result, of_result), F.lit(False))
    return (kind == "session_start") | F.coalesce(keep, F.lit(False))


def filter_events(events: DataFrame, c: Criteria, block_rows: int | None = None) -> DataFrame:
    """Skills, then turns, then events: an event that chose a session may itself be filtered out. Events come with their context. block_rows: as with_context() has it, for sessions of any length."""
    kept = with_context(by_skill(events, c.skills or ()), block_rows)
    if c.tools:
        kept = joins.with_called_name(kept)  # a result's call may lie outside what is kept, so it is looked up first
    if c.last_turns:
        kept = last_turns(kept, c.last_turns)
    kept = kept.where(event_filter(c))
    return kept.drop("called_name") if c.tools else kept


def has_trim(tool_lines: int | None = None, no_thinking: bool = False) -> bool:
    """Whether trim() would change anything."""
    return tool_lines is not None or no_thinking


def trim(events: DataFrame, tool_lines: int | None = None, no_thinking: bool = False) -> DataFrame:
    """Without all but the first lines of results' and custom messages' texts, and without thinking. No row goes."""
    from ..functions.text import first_lines

    if tool_lines is not None:
        cut = F.col("type").isin("tool_result", "custom_message")
        events = events.withColumn("content", F.when(cut, first_lines("content", tool_lines)).otherwise(F.col("content")))
    if no_thinking:
        events = events.withColumn("thinking", F.lit(None).cast(events.schema["thinking"].dataType))
    return events


def admitted(events: DataFrame) -> DataFrame:
    """The sessions whose first event is their header."""
    first = F.min_by("type", "seq").over(Window.partitionBy("sid"))
    return events.withColumn("_first", first).where(F.col("_first") == "session_start").drop("_first")


def in_folder_and_time(events: DataFrame, cwd: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """The sessions whose header fits; a header without a time fits any time."""
    starts = events.where(F.col("type") == "session_start")
    if cwd:
        starts = starts.where(F.lower("cwd").contains(cwd.lower()))
    at = F.try_to_timestamp(F.nullif("timestamp", F.lit("")))
    if since:
        starts = starts.where(at.isNull() | (at >= F.lit(since).cast("timestamp")))
    if until:
        starts = starts.where(at.isNull() | (at <= F.lit(until).cast("timestamp")))
    return events.join(starts.select("sid").distinct(), "sid", "left_semi") if cwd or since or until else events


class HeadPathError(ValueError):
    pass


def _cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the folder in spark.checkpoint.dir."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def head_path(entries: DataFrame, heads: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """The entries (keys, id, parent_id, seq) on the way from each head (keys, head) to its root.

    After k rounds a table of 2**k-step ancestors has doubled the part of the path that is known, so a path of n entries
    takes log2(n) rounds, each two joins by entry. An id that occurs twice, a head that isn't there and a cycle are errors.
    """
    on = [*keys, "id"]
    entries = _cut(entries)  # read in every round
    if entries.groupBy(*on).count().where("count > 1").limit(1).count():
        raise HeadPathError("duplicate entry ID")
    path = heads.select(*keys, F.col("head").alias("id"))
    if path.join(entries, on, "left_anti").limit(1).count():
        raise HeadPathError("head was not found")
    known = entries.select(*on)
    jump = entries.select(*on, F.col("parent_id").alias("up")).join(known.withColumnRenamed("id", "up"), [*keys, "up"], "left_semi").select(*on, "up")
    path = _cut(path)
    rounds = max(1, int(entries.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1).bit_length())
    for _ in range(rounds + 1):
        further = path.join(jump, on).select(*keys, F.col("up").alias("id"))
        grown = _cut(path.unionByName(further).distinct())
        if grown.count() == path.count():
            break
        path = grown
        over = jump.select(*keys, F.col("id").alias("up"), F.col("up").alias("further"))
        jump = _cut(jump.join(over, [*keys, "up"]).select(*on, F.col("further").alias("up")))
    if path.join(jump.where(F.col("id") == F.col("up")), on, "left_semi").limit(1).count() or _loops(entries, path, keys):
        raise HeadPathError("cycle in the entries")
    return entries.join(path, on, "left_semi")


def _loops(entries: DataFrame, path: DataFrame, keys: tuple[str, ...]) -> bool:
    """A path without a cycle has one entry whose parent isn't on it."""
    own = entries.join(path, [*keys, "id"], "left_semi")
    parents = path.select(*keys, F.col("id").alias("parent_id"))
    roots = own.join(parents, [*keys, "parent_id"], "left_anti").groupBy(*keys).count()
    return path.select(*keys).distinct().join(roots, list(keys), "left_anti").limit(1).count() > 0
