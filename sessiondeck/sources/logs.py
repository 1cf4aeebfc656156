"""Log files to the canonical event table.

Spark lists and reads the files; each is parsed where it is read, as one record, since a log's meaning depends on its order.
There is no shuffle: a file's events are made in one task, and all later operators share the partitioning by session. A file
over `LARGE` bytes is read by lines instead, which are brought together in order and parsed as they come, so that a task holds
one value at a time (but a format's own look-ahead); that way has no limit of size.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from typing import Any
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import EVENT_SCHEMA, to_row
from .formats.base import Format, HeadError
from .json_values import MalformedRecord
from .registry import Registry, default_registry

BATCH = 2000
LARGE = 1 << 30  # a record of Spark holds up to 2 GB
MODES = ("failfast", "permissive")


class UnknownFormat(ValueError):
    pass


def local_name(path: str) -> str:
    """A path as it was given: Spark names local files by URI."""
    at = urlparse(path)
    return unquote(at.path) if at.scheme == "file" else path


def _known(text: str | Iterator[str], registry: Registry, source: str | None, head: str | None) -> tuple[Format | None, str | Iterator[str]]:
    """The format, and the text as this can take it."""
    if isinstance(text, str):
        return (registry.get(source) if source else registry.detect(text)), text
    begin = ""
    for part in text:
        begin += part
        if len(begin) >= 1 << 16:
            break
    known = registry.get(source) if source else registry.detect(begin)
    if known is not None and known.in_parts and head is None:
        return known, chain([begin], text)
    whole = begin + "".join(text)
    return known or registry.detect(whole), whole


def session_events(text: str | Iterator[str], path: str, registry: Registry, source: str | None = None, head: str | None = None) -> Iterator[dict[str, Any]]:
    """One log's events, with the calls' normalized names."""
    known, text = _known(text, registry, source, head)
    if known is None:
        raise UnknownFormat(f"unknown session format: {path}")
    if head is not None and not head.strip():
        raise HeadError("head ID must not be empty")
    if head is not None and known.head is None:
        raise HeadError(f'format "{known.name}" does not support head selection')
    for event in known.head(text, path, head) if head is not None else known.parse(text, path):
        for call in event.get("toolCalls") or []:
            if call.get("normalizedName") is None:
                call["normalizedName"] = known.normalize(call["name"], call["arguments"])
        yield event


def rows_of(text: str | Iterator[str], path: str, registry: Registry, source: str | None = None, head: str | None = None, mode: str = "failfast", admitted: bool = True, first_seq: int = 0) -> Iterator[dict[str, Any]]:
    """A log's rows. admitted: none of a log that doesn't begin with its header. permissive: what comes before a fault is kept."""
    sid, seq, name = "", 0, os.path.basename(path)
    made = session_events(text, path, registry, source, head)
    while True:
        try:
            event = next(made, None)
        except (MalformedRecord, UnknownFormat):
            if mode == "failfast":
                raise
            return
        if event is None:
            return
        if not seq:
            if admitted and event["type"] != "session_start":
                return
            sid = (event["id"] if event["type"] == "session_start" else "") or os.path.splitext(name)[0]
        yield to_row(event | ({"path": path} if event["type"] == "session_start" else {}), sid, first_seq + seq)
        seq += 1


def read_logs(spark: SparkSession, paths: str | Iterable[str], source: str | None = None, head: str | None = None, registry: Registry | None = None, mode: str = "failfast", admitted: bool = True, first_seq: dict[str, int] | None = None, large: int = LARGE) -> DataFrame:
    """The events of all logs at the paths (files, folders or globs, as Spark reads them). first_seq: by path, the number of a log's first event, else 0. large: bytes above which a log is read by lines."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    registry = registry or default_registry()
    if source is not None and registry.get(source) is None:
        raise ValueError(f"unknown source: {source}")
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        return spark.createDataFrame([], EVENT_SCHEMA)
    files = spark.read.format("binaryFile").load(paths)
    long = [r["path"] for r in files.where(F.col("length") > large).select("path").collect()]  # few: each is over a gigabyte
    found = parse_logs(files.where(F.col("length") <= large), source, head, registry, mode, admitted, first_seq)
    if not long:
        return found
    lines = spark.read.text(long).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    return found.unionByName(parse_lines(lines, source, head, registry, mode, admitted, first_seq))


def parse_logs(files: DataFrame, source: str | None = None, head: str | None = None, registry: Registry | None = None, mode: str = "failfast", admitted: bool = True, first_seq: dict[str, int] | None = None) -> DataFrame:
    """The events of logs that are rows: `path` and `content` (binary)."""
    registry, kind = registry or default_registry(), to_arrow_schema(EVENT_SCHEMA)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, Any]] = []
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for row in rows_of((content or b"").decode("utf-8", "replace"), local_name(path), registry, source, head, mode, admitted, (first_seq or {}).get(local_name(path), 0)):
                    held.append(row)
                    if len(held) >= BATCH:
                        yield pa.RecordBatch.from_pylist(held, kind)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kind)

    return files.select("path", "content").mapInArrow(parse, EVENT_SCHEMA)


def parse_lines(lines: DataFrame, source: str | None = None, head: str | None = None, registry: Registry | None = None, mode: str = "failfast", admitted: bool = True, first_seq: dict[str, int] | None = None) -> DataFrame:
    """The events of logs whose lines are rows: `path`, `value`, and their order by `block` and `i`. A log's lines come together in one task and stream through it."""
    registry, kind = registry or default_registry(), to_arrow_schema(EVENT_SCHEMA)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        held: list[dict[str, Any]] = []
        for path, own in groupby(rows, key=lambda pair: pair[0]):
            name = local_name(path)
            for row in rows_of((value if not i else f"\n{value}" for i, (_, value) in enumerate(own)), name, registry, source, head, mode, admitted, (first_seq or {}).get(name, 0)):
                held.append(row)
                if len(held) >= BATCH:
                    yield pa.RecordBatch.from_pylist(held, kind)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, kind)

    return lines.repartition("path").sortWithinPartitions("path", "block", "i").select("path", "value").mapInArrow(parse, EVENT_SCHEMA)
