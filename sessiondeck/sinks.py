"""Where rendered lines go. Nothing is overwritten, and no output may lie among the inputs."""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable
from contextlib import suppress
from typing import TextIO

from pyspark.sql import DataFrame, functions as F

EXTENSIONS = {"ndjson": "jsonl", "md": "md"}


class SinkError(ValueError):
    pass


class ClosedOutput(Exception):
    """Whoever reads standard output has had enough."""



def to_stdout(lines: Iterable[str], out: TextIO | None = None) -> int:
    out, n = out or sys.stdout, 0
    try:
        for line in lines:
            out.write(line)
            n += 1
        out.flush()
    except BrokenPipeError as error:
        with suppress(OSError):
            os.dup2(os.open(os.devnull, os.O_WRONLY), sys.stdout.fileno())
        raise ClosedOutput from error
    return n


def open_new(path: str) -> TextIO:
    """A file that wasn't there; its folder is made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return open(path, "x", encoding="utf-8", newline="")


def session_path(folder: str, sid: str, extension: str) -> str:
    if not sid or sid in (".", "..") or re.search(r"[/\\:\x00]", sid):
        raise SinkError(f"unsafe session ID: {sid!r}")
    root = os.path.abspath(folder)
    path = os.path.abspath(os.path.join(root, f"{sid}.{extension}"))
    if os.path.dirname(path) != root:
        raise SinkError(f"session output leaves its folder: {sid!r}")
    return path


def apart(inputs: Iterable[str], file: str | None = None, folder: str | None = None) -> list[str]:
    """The inputs, once it is known that the output isn't one of them and that the output folder holds none. Links are followed."""
    known = list(inputs)
    real = [os.path.realpath(x) for x in known]
    if file is not None and os.path.realpath(file) in real:
        raise SinkError(f"output is an input: {file}")
    if folder is not None:
        root = os.path.realpath(folder)
        for x, y in zip(known, real, strict=True):
            if os.path.commonpath([root, y]) == root:
                raise SinkError(f"input lies in the output folder: {x}")
    return known


def write_table(lines: DataFrame, path: str) -> None:
    """All sessions' lines as text files in a folder for each session, written by the executors: for results too large for one machine."""
    lines.select("sid", F.regexp_replace("line", "\n$", "").alias("value")).write.partitionBy("sid").mode("errorifexists").text(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """Few rows as one file with a header line."""
    with open_new(path) as f:
        f.write("\t".join(rows.columns) + "\n")
        for r in rows.toLocalIterator():
            f.write("\t".join("" if x is None else str(x) for x in r) + "\n")
