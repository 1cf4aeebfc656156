"""Turns, the active model and segments, as columns.

A turn is a user's message and what follows until the next one; what comes before the first is a preamble, of turn 0. A
session_start begins anew. Window functions over a session need its events in one task; a session is one agent's run, a log
file, so its size is bounded by what one run writes, however many sessions there are. For sources where a session may be
any part of the table, with_context(block_rows=...) works by blocks of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def session() -> WindowSpec:
    return Window.partitionBy("sid").orderBy("seq")


def running(flag: Column, window: WindowSpec | None = None) -> Column:
    """How often the flag was set so far, this row included."""
    return F.sum(F.when(flag, 1).otherwise(0)).over((window or session()).rowsBetween(Window.unboundedPreceding, 0))


def _flags() -> tuple[Column, Column, Column, Column]:
    """Header, user's message, compaction; and the model that a row makes active."""
    is_start, is_user, is_cut = (F.col("type") == t for t in ("session_start", "user_message", "compaction"))
    named = F.when((is_start | (F.col("type") == "assistant_message")) & (F.col("model") != ""), F.col("model")).when(is_start, F.lit(""))
    return is_start, is_user, is_cut, named


def with_context(events: DataFrame, block_rows: int | None = None) -> DataFrame:
    """events with `run_no`, `turn_no`, `active_model` and `segment`. block_rows: for sessions that one task can't hold."""
    if block_rows:
        return _with_context_by_blocks(events, block_rows)
    is_start, is_user, is_cut, named = _flags()
    own = Window.partitionBy("sid", "run_no").orderBy("seq")
    before = own.rowsBetween(Window.unboundedPreceding, 0)
    return (
        events.withColumn("run_no", running(is_start))
        .withColumn("turn_no", running(is_user, own))
        .withColumn("active_model", F.coalesce(F.last(named, ignorenulls=True).over(before), F.lit("")))
        .withColumn("segment", running(is_cut, own))
    )


def _with_context_by_blocks(events: DataFrame, block_rows: int) -> DataFrame:
    """The same by blocks of positions: sums within a block, then each block's offsets from a row for each block.

    The events are shuffled once, by session and block, so a session of any length spreads over the cluster; what a task
    gathers of one session is its blocks' summaries.
    """
    is_start, is_user, is_cut, named = _flags()
    inner = Window.partitionBy("sid", "_block").orderBy("seq")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("_block", F.floor(F.col("seq") / F.lit(block_rows)))
    for name, flag in (("_runs", is_start), ("_users", is_user), ("_cuts", is_cut)):
        rows = rows.withColumn(name, running(flag, inner))
    rows = rows.withColumn("_model", F.last(named, ignorenulls=True).over(upto))
    # counts at the last header of the block, from which turns and segments count
    rows = rows.withColumn("_from", F.last(F.when(is_start, F.struct("_users", "_cuts")), ignorenulls=True).over(upto))
    ends = rows.groupBy("sid", "_block").agg(F.max_by(F.struct("_runs", "_users", "_cuts", "_model", "_from"), "seq").alias("e"))
    past = Window.partitionBy("sid").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    add = lambda c: F.coalesce(F.sum(F.col("e")[c]).over(past), F.lit(0))
    ends = ends.select("sid", "_block", "e", add("_runs").alias("_runs0"), add("_users").alias("_users0"), add("_cuts").alias("_cuts0"), F.last("e._model", ignorenulls=True).over(past).alias("_model0"))
    header = F.when(F.col("e._from").isNotNull(), F.struct((F.col("_users0") + F.col("e._from._users")).alias("u"), (F.col("_cuts0") + F.col("e._from._cuts")).alias("c")))
    ends = ends.withColumn("_h", header).withColumn("_from0", F.last("_h", ignorenulls=True).over(past)).drop("e", "_h")
    both = rows.join(ends, ["sid", "_block"])
    base = lambda own, all_, before: F.coalesce(F.col(f"{all_}0") + F.col(f"_from.{own}"), F.col(f"_from0.{before}"), F.lit(0))
    return (
        both.withColumn("run_no", F.col("_runs0") + F.col("_runs"))
        .withColumn("turn_no", F.col("_users0") + F.col("_users") - base("_users", "_users", "u"))
        .withColumn("active_model", F.coalesce("_model", "_model0", F.lit("")))
        .withColumn("segment", F.col("_cuts0") + F.col("_cuts") - base("_cuts", "_cuts", "c"))
        .select(*events.columns, "run_no", "turn_no", "active_model", "segment")
    )


def turn() -> WindowSpec:
    return Window.partitionBy("sid", "run_no", "turn_no").orderBy("seq")


def with_turn_events(context: DataFrame, *fields: str) -> DataFrame:
    """context with `turn_events`: the fields of the turn's earlier events, without its user's message. It grows with the square of a turn; prefer with_prior or a join where that will do."""
    row = F.when(F.col("type") != "user_message", F.struct(*[F.col(c) for c in fields or ("seq", "type")]))
    earlier = F.collect_list(row).over(turn().rowsBetween(Window.unboundedPreceding, -1))
    return context.withColumn("turn_events", F.when(F.col("turn_no") > 0, earlier))


def with_prior(context: DataFrame, flag: Column, name: str) -> DataFrame:
    """context with the number of the turn's earlier events for which the flag is set."""
    n = F.sum(F.when(flag, 1).otherwise(0)).over(turn().rowsBetween(Window.unboundedPreceding, -1))
    return context.withColumn(name, F.coalesce(F.when(F.col("turn_no") > 0, n), F.lit(0)))


def turns(context: DataFrame) -> DataFrame:
    """A row for each turn: the user's message and counts."""
    in_turn = context.where("turn_no > 0")
    is_reply = (F.col("type") == "assistant_message") & (F.trim("text") != "")
    return in_turn.groupBy("sid", "run_no", "turn_no").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("text", "seq").alias("user_text"),
        F.count_if(F.col("type") == "assistant_message").alias("assistant_messages"), F.count_if(F.col("type") == "tool_result").alias("tool_results"),
        F.max_by(F.when(is_reply, F.col("text")), F.when(is_reply, F.col("seq"))).alias("last_reply"),
    )


def with_previous_reply(context: DataFrame) -> DataFrame:
    """The users' messages with `previous_reply`: the last text that isn't blank of the turn before."""
    replies = turns(context).select("sid", "run_no", (F.col("turn_no") + 1).alias("turn_no"), F.col("last_reply").alias("previous_reply"))
    return context.where(F.col("type") == "user_message").join(replies, ["sid", "run_no", "turn_no"], "left")


def carried(value: Column, window: WindowSpec | None = None) -> Column:
    """The last value so far that isn't null."""
    return F.last(value, ignorenulls=True).over((window or session()).rowsBetween(Window.unboundedPreceding, 0))


def islands(events: DataFrame, ends: Column, members: Column, name: str = "island") -> DataFrame:
    """The member rows with the number of the island they are in; a row for which `ends` is set closes one."""
    return events.withColumn(name, running(ends)).where(members)


def parent_chain(events: DataFrame) -> DataFrame:
    """events with `parent_id` of the event before, as linear logs have it."""
    return events.withColumn("parent_id", F.lag("id").over(session()))
