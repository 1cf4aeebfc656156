"""Counts and sums by session, segment, first turn and class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.classify import error_name
from ..functions.text import trimmed
from . import joins
from .context import with_context


def _is(kind: str) -> Column:
    return F.col("type") == kind


def failed() -> Column:
    return _is("tool_result") & F.coalesce(F.col("is_error"), F.lit(False))


def run_stats(events: DataFrame) -> DataFrame:
    return events.agg(F.count_distinct(F.when(_is("session_start"), F.col("sid"))).alias("sessions_found"), F.count_distinct("sid").alias("sessions_written"), F.count("*").alias("events_written"))


def session_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("sid").agg(F.count_if(_is("assistant_message")).alias("asst"), F.count_if(_is("tool_result")).alias("tools"), F.count_if(failed()).alias("errs"))


def session_span(events: DataFrame) -> DataFrame:
    at = F.nullif(F.col("timestamp"), F.lit(""))
    return events.groupBy("sid").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"))


def span_text(first: Column, last: Column) -> Column:
    told = F.concat(F.substring(first, 12, 5), F.lit(" → "), F.substring(last, 12, 5), F.lit(" UTC ("), F.substring(first, 1, 10), F.lit(")"))
    return F.coalesce(told, F.lit("unknown"))


def tool_histogram(events: DataFrame, *keys: str) -> DataFrame:
    """Calls by name, and where each name was first seen, by which ties are ordered."""
    return joins.calls(events).groupBy(*keys, F.coalesce("name", F.lit("?")).alias("name")).agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("first_seen"))


def error_tally(events: DataFrame) -> DataFrame:
    """Failed calls by the class of their error, and the total, whose name is null."""
    bad = joins.calls_with_results(events).where(F.col("result.is_error"))
    return bad.select(error_name(F.col("result.content"), F.col("result.exit_code")).alias("error_name")).rollup("error_name").agg(F.count("*").alias("n"))


def duplicates(entries: DataFrame, *keys: str) -> DataFrame:
    return entries.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def segment_counts(events: DataFrame, *more: str) -> DataFrame:
    """Counts of each segment; segments without events have zeros, for n compactions make n + 1 segments."""
    inner = with_context(events).where(~F.col("type").isin("session_start", "compaction"))
    sums = inner.groupBy("sid", "segment").agg(
        F.count_if(_is("user_message")).alias("user"),
        F.count_if(_is("assistant_message") & (trimmed("text") != "")).alias("assistant_text"),
        F.sum(F.when(_is("assistant_message"), F.coalesce(F.size("tool_calls"), F.lit(0))).otherwise(0)).alias("tool_call"),
        F.count_if(_is("tool_result")).alias("tool_result"),
        F.coalesce(F.sum("usage.input"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("usage.output"), F.lit(0)).alias("tokens_out"),
    )
    every = events.groupBy("sid", *more).agg(F.count_if(_is("compaction")).alias("cuts")).select("sid", *more, F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts"))).alias("segment"))
    names = ("user", "assistant_text", "tool_call", "tool_result", "tokens_in", "tokens_out")
    return every.join(sums, ["sid", "segment"], "left").fillna(0, list(names)).select("sid", *more, "segment", *names)


FIRST_TURN = ("asst_turns", "tool_calls", "output_tokens", "input_tokens", "cache_read")


def first_turns(events: DataFrame, *more: str, active: bool = True) -> DataFrame:
    """Sums over each segment's first turn: from its first user's message to the next, the compaction or the end. active: only turns in which the assistant spoke."""
    context = with_context(events)
    within = Window.partitionBy("sid", "run_no", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    nth = F.sum(F.when(_is("user_message"), 1).otherwise(0)).over(within)
    first = context.withColumn("_nth", nth).where("_nth = 1")
    spoke = _is("assistant_message")
    add = lambda x: F.coalesce(F.sum(F.when(spoke, x)), F.lit(0))
    out = first.groupBy("sid", "segment", *more).agg(
        F.count_if(spoke).alias("asst_turns"), add(F.coalesce(F.size("tool_calls"), F.lit(0))).alias("tool_calls"),
        add(F.col("usage.output")).alias("output_tokens"), add(F.col("usage.input")).alias("input_tokens"), add(F.col("usage.cache_read")).alias("cache_read"),
    )
    return out.where("asst_turns > 0") if active else out


def distribution(rows: DataFrame, metrics: tuple[str, ...] = FIRST_TURN, group: str | None = None, every: str = "All", ranks: tuple[float, ...] = (0.5, 0.9, 0.99)) -> DataFrame:
    """name (of the group, and `every` for all rows), metric, n, mean, max and the values at position floor(n * p) of the sorted ones.

    Values are counted first, so what one task sorts is a group's distinct values, not its rows.
    """
    names = F.array(F.lit(every), F.col(group).cast("string")) if group else F.array(F.lit(every))
    long = rows.select(F.explode(names).alias("name"), F.explode(F.map_from_arrays(F.array(*map(F.lit, metrics)), F.array(*[F.col(m).cast("long") for m in metrics]))).alias("metric", "value"))
    counted = long.groupBy("name", "metric", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy("name", "metric")
    placed = counted.withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(float(p)))), F.col("value")))
    return placed.groupBy("name", "metric").agg(
        F.max("n").alias("n"), (F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("mean"), F.max("value").alias("max"), *[at(p).alias(f"p{round(p * 100)}") for p in ranks]
    )


def totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("output_tokens", "input_tokens", "cache_read")])


def longest(rows: DataFrame, order: tuple[str, ...], n: int = 10) -> DataFrame:
    """The n rows of most output; ties by the report's order."""
    return rows.orderBy(F.col("output_tokens").desc(), *order).limit(n)
