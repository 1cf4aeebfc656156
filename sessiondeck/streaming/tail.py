"""Logs that agents are still writing, as a stream: what is appended arrives with the next batch.

The source's position is the size of each log when a batch was planned. A batch reads the logs that have grown, up to their
new size, and gives the events beyond those that the old size held; a value that isn't whole yet waits for the next batch.
Sizes are taken on the driver and logs are read by the tasks, so the folder is one that all share. The position names every
log, so a folder holds as many as one list may; a log's events so far are parsed again whenever it grows. A header whose model
comes later was given without it. For formats of JSON values; an export of text is finished when it is written.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import EVENT_SCHEMA
from ..sources.logs import rows_of
from ..sources.registry import default_registry


@dataclass
class Grown(InputPartition):
    """A log, and its old and new size."""

    path: str
    begin: int
    end: int


class TailReader(DataSourceStreamReader):
    def __init__(self, folder: str, pattern: str, source: str | None, mode: str) -> None:
        self.folder, self.pattern, self.source, self.mode = folder, pattern, source, mode

    def initialOffset(self) -> dict:  # noqa: N802  the names are Spark's
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        found = {}
        for folder, _, names in os.walk(self.folder):
            for name in sorted(fnmatch.filter(names, self.pattern)):
                try:
                    found[os.path.join(folder, name)] = os.path.getsize(os.path.join(folder, name))
                except OSError:  # it went meanwhile
                    continue
        return found

    def partitions(self, start: dict, end: dict) -> list[Grown]:
        return [Grown(path, start.get(path, 0), size) for path, size in sorted(end.items()) if size > start.get(path, 0)]

    def read(self, part: Grown) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            data = f.read(part.end)
        registry, kind = default_registry(), to_arrow_schema(EVENT_SCHEMA)
        events = lambda raw: rows_of(raw.decode("utf-8", "replace"), part.path, registry, self.source, mode=self.mode) if raw.strip() else iter(())
        known = sum(1 for _ in events(data[: part.begin]))
        rows = [row for i, row in enumerate(events(data)) if i >= known]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kind)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_logs"

    def schema(self) -> StructType:
        return EVENT_SCHEMA

    def streamReader(self, schema: StructType) -> TailReader:  # noqa: N802
        o = self.options
        return TailReader(o["path"], o.get("pattern", "*.jsonl"), o.get("source"), o.get("mode", "failfast"))


def follow_logs(spark: SparkSession, folder: str, pattern: str = "*.jsonl", source: str | None = None, mode: str = "failfast") -> DataFrame:
    """A stream of the events of a folder's logs, each once, also of what is appended to them. A fault in a log ends the stream; with mode "permissive", that log's events end before it."""
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("session_logs").option("pattern", pattern).option("mode", mode)
    return (reader.option("source", source) if source else reader).load(folder)
