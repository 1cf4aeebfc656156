"""Context of events as they arrive, and counts by time.

Events of a session have to arrive in order between batches; within a batch they are sorted. A session's state is four small
values; if `idle` is given, it is dropped after so long without events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CONTEXT = "sid string, seq long, type string, run_no long, turn_no long, active_model string, segment long"
STATE = "run_no long, turn_no long, active_model string, segment long"


def step(state: tuple[int, int, str, int], kind: str, model: str | None) -> tuple[int, int, str, int]:
    """The state after an event."""
    run, turn, active, segment = state
    if kind == "session_start":
        return run + 1, 0, model or "", 0
    if kind == "user_message":
        turn += 1
    elif kind == "compaction":
        segment += 1
    elif kind == "assistant_message" and model:
        active = model
    return run, turn, active, segment


def streaming_context(events: DataFrame, idle: str | None = None) -> DataFrame:
    """sid, seq, type, run_no, turn_no, active_model and segment of a stream of events. With `idle` the query also runs without new data, to drop old state."""
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def follow(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = tuple(held.get) if held.exists else (0, 0, "", 0)
        rows = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            state = step(state, r.type, r.model)
            rows.append((key[0], r.seq, r.type, *state))
        held.update(state)
        if idle:
            held.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(rows, columns=["sid", "seq", "type", "run_no", "turn_no", "active_model", "segment"])

    return events.select("sid", "seq", "type", "model").groupBy("sid").applyInPandasWithState(follow, CONTEXT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)


def _late(events: DataFrame, at: str, late: str) -> DataFrame:
    """A stream's events with a watermark, which needs instants."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", at: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events and their value in cents by window and kind; of a stream, those not later than the watermark."""
    rows = _late(events, at, late)
    window = F.window(at, length, slide) if slide else F.window(at, length)
    counted = rows.groupBy(window.alias("w"), kind).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), kind, "n", "cents")


def gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", at: str = "ts", key: str = "user_id") -> DataFrame:
    """Runs of a key's events without a longer gap, for sources that don't mark their sessions."""
    rows = _late(events, at, late)
    counted = rows.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def live_logs(spark: SparkSession, folder: str, pattern: str = "*.jsonl", max_files: int = 1000) -> DataFrame:
    """A stream of the events of logs as they are put in a folder; each log is read once, when it appears, up to its last whole record. For logs that grow there is tail.follow_logs."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from ..schema import EVENT_SCHEMA
    from ..sources.logs import local_name, rows_of
    from ..sources.registry import default_registry

    registry, kind = default_registry(), to_arrow_schema(EVENT_SCHEMA)
    binary = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = spark.readStream.format("binaryFile").schema(binary).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(folder)

    def parse(batches: Iterator[Any]) -> Iterator[Any]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = list(rows_of(content.decode("utf-8", "replace"), local_name(path), registry, mode="permissive"))
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return files.select("path", "content").mapInArrow(parse, EVENT_SCHEMA)
