"""Calls and their results, by turn, by order, by position and by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def calls(events: DataFrame, *more: str) -> DataFrame:
    """A row for each tool call: sid, seq, pos, call_id, name, normalized_name, arguments, and the columns named."""
    exploded = events.where(F.col("type") == "assistant_message").select("sid", "seq", *more, F.posexplode("tool_calls").alias("pos", "call"))
    return exploded.select("sid", "seq", "pos", *more, F.col("call.id").alias("call_id"), F.col("call.name").alias("name"), F.col("call.normalized_name").alias("normalized_name"), F.col("call.arguments").alias("arguments"))


def with_call_in_turn(context: DataFrame) -> DataFrame:
    """context with `call`: of a result, the first call of its id in its own turn and before it.

    Each call becomes a row of its own beside its event, and a window over the rows of one id in one turn looks back. It is
    partitioned by session first, as the context is, so there is no exchange and no join.
    """
    names = ("name", "normalized_name", "arguments")
    of_result = F.when(F.col("type") == "tool_result", F.col("tool_call_id"))
    none = F.struct(*[F.lit(None).cast("string").alias(c) for c in names])
    own = F.array(F.struct(of_result.alias("id"), F.lit(-1).alias("pos"), F.when(F.lit(False), none).alias("call")))
    made = F.transform(F.coalesce("tool_calls", F.array()), lambda x, i: F.struct(x["id"].alias("id"), i.alias("pos"), F.struct(*[x[c].alias(c) for c in names]).alias("call")))
    rows = context.withColumn("_mark", F.explode(F.when(F.col("type") == "assistant_message", F.concat(own, made)).otherwise(own)))
    before = Window.partitionBy("sid", "run_no", "turn_no", "_mark.id").orderBy("seq", "_mark.pos").rowsBetween(Window.unboundedPreceding, -1)
    found = F.when(of_result.isNotNull() & (F.col("turn_no") > 0), F.first("_mark.call", ignorenulls=True).over(before))
    return rows.withColumn("call", found).where("_mark.pos = -1").drop("_mark")


def with_called_name(context: DataFrame) -> DataFrame:
    """context with `called_name`: the normalized name of a result's call, null if there is none."""
    return with_call_in_turn(context).withColumn("called_name", F.col("call.normalized_name")).drop("call")


def names_as_of(events: DataFrame) -> DataFrame:
    """The results with `called`: the name of the last call of their id before them, or the empty text."""
    made = calls(events).select("sid", "call_id", "seq", F.col("pos").alias("pos"), "name", F.lit(False).alias("is_result"))
    asked = events.where(F.col("type") == "tool_result").select("sid", F.col("tool_call_id").alias("call_id"), "seq", F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("name"), F.lit(True).alias("is_result"))
    before = Window.partitionBy("sid", "call_id").orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, -1)
    both = made.unionByName(asked).withColumn("called", F.coalesce(F.last("name", ignorenulls=True).over(before), F.lit("")))
    return both.where("is_result").select("sid", "seq", "call_id", "called")


def zip_by_position(left: DataFrame, right: DataFrame, key: str = "sid", order: str = "seq") -> DataFrame:
    """The i-th row of left with the i-th of right, within the key; `right` as a struct, null where there is none."""
    place = Window.partitionBy(key).orderBy(order)
    others = right.select(F.col(key), F.row_number().over(place).alias("_i"), F.struct(*[c for c in right.columns if c != key]).alias("right"))
    return left.withColumn("_i", F.row_number().over(place)).join(others, [key, "_i"], "left").drop("_i")


def calls_with_results(events: DataFrame, *more: str) -> DataFrame:
    """All calls with the session's last result of their id, if any: `result` struct<is_error, content, exit_code, seq>."""
    last = (
        events.where(F.col("type") == "tool_result").groupBy("sid", F.col("tool_call_id").alias("call_id"))
        .agg(F.max_by(F.struct("is_error", "content", "exit_code", "seq"), "seq").alias("result"))
    )
    return calls(events, *more).join(last, ["sid", "call_id"], "left")


def in_window(at: Column, low: Column, high: Column) -> Column:
    """low <= at < high, by the order of texts; an empty or null bound is open."""
    return ((F.coalesce(low, F.lit("")) == "") | (at >= low)) & ((F.coalesce(high, F.lit("")) == "") | (at < high))


def by_phase(events: DataFrame, phases: DataFrame) -> DataFrame:
    """events with each phase (phase, low, high) whose time they are in. Phases are a report's few configured lines and are broadcast."""
    at = F.coalesce(F.col("timestamp"), F.lit(""))
    return events.join(F.broadcast(phases), in_window(at, F.col("low"), F.col("high")))


def looked_up(rows: DataFrame, book: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """rows with the columns of a small book, or the defaults."""
    found = rows.join(F.broadcast(book), key, "left")
    for name, value in defaults.items():
        found = found.withColumn(name, F.coalesce(F.col(name), value))
    return found


def sub_sessions(events: DataFrame) -> DataFrame:
    """Each session that names a parent, with its parent's header if that is there."""
    starts = events.where(F.col("type") == "session_start")
    child = starts.where(F.col("parent_session").isNotNull()).select("sid", F.col("parent_session").alias("parent_sid"))
    return child.join(starts.select(F.col("sid").alias("parent_sid"), F.col("cwd").alias("parent_cwd"), F.col("model").alias("parent_model")), "parent_sid", "left")
