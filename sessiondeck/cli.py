"""python -m sessiondeck: one log, or the logs that are found, to lines of JSON or Markdown.

Usage errors end with 2 before anything is read, other failures with 1; a reader of standard output that stops early is none.
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import time
from datetime import datetime, timedelta, timezone

from . import __version__, api, sinks
from .operators.select import MAX_SAFE, Criteria
from .schema import ROLES, TYPES
from .scanners import load_scanner
from .sources.discovery import Search, discover
from .sources.registry import default_registry


class UsageError(Exception):
    pass


class _Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise UsageError(message)


def whole_number(flag: str, least: int):
    said = f"{flag} requires a {'positive' if least else 'non-negative'} integer"

    def parse(text: str) -> int:
        if not re.fullmatch(r"0|[1-9][0-9]*", text) or not least <= int(text) <= MAX_SAFE:
            raise UsageError(said)
        return int(text)

    return parse


def words(flag: str, choices: tuple[str, ...] | None = None):
    def parse(text: str) -> tuple[str, ...]:
        found = tuple(x.strip() for x in text.split(","))
        if not all(found):
            raise UsageError(f"{flag} requires non-empty comma-separated values")
        if choices and set(found) - set(choices):
            raise UsageError(f"{flag} must contain only: {', '.join(choices)}")
        return found

    return parse


def moment(flag: str):
    def parse(text: str) -> datetime:
        try:
            at = datetime.fromisoformat(text.strip())
        except ValueError:
            raise UsageError(f"{flag} requires a valid date") from None
        return at if at.tzinfo else at.replace(tzinfo=timezone.utc)

    return parse


def filled(flag: str):
    def parse(text: str) -> str:
        if not text.strip():
            raise UsageError(f"{flag} requires a non-empty value")
        return text

    return parse


def one_of(flag: str, *choices: str):
    def parse(text: str) -> str:
        if text not in choices:
            raise UsageError(f"{flag} must be " + " or ".join(f'"{c}"' for c in choices))
        return text

    return parse


def parser() -> argparse.ArgumentParser:
    p = _Parser(prog="sessiondeck", description="Normalize one session log, or find logs if none is named. Lines of JSON go to standard output; what happened goes to standard error.", allow_abbrev=False)
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("input", nargs="*", help="one session log")
    g = p.add_argument_group("locate")
    g.add_argument("--cwd", type=filled("--cwd"), help="part of the working folder, or all (default: the current project)")
    g.add_argument("--since", type=moment("--since"), help="default: seven days ago")
    g.add_argument("--until", type=moment("--until"))
    g.add_argument("--source", type=filled("--source"), help="a format's name")
    g.add_argument("--adapter", type=filled("--adapter"), action="append", default=[], help="load a format (repeatable)")
    g.add_argument("--include-subagents", action="store_true")
    g.add_argument("--head", help="the entry that ends the branch (with one input)")
    g = p.add_argument_group("filter")
    g.add_argument("--skill", type=words("--skill"), help="sessions in which a skill was invoked")
    g.add_argument("--last-turns", type=whole_number("--last-turns", 1))
    g.add_argument("--type", type=words("--type", TYPES))
    g.add_argument("--role", type=words("--role", tuple(ROLES)))
    g.add_argument("--tool", type=words("--tool"), help="normalized names")
    g.add_argument("--error", action="store_true", help="failed results only")
    g.add_argument("--tool-results", type=one_of("--tool-results", "all", "errors"))
    g = p.add_argument_group("transform")
    g.add_argument("--scanner", type=filled("--scanner"), help="a file with scan or scan_session; takes the place of trimming")
    g.add_argument("--tool-lines", type=whole_number("--tool-lines", 0))
    g.add_argument("--no-thinking", action="store_true")
    g = p.add_argument_group("output")
    g.add_argument("--format", type=one_of("--format", "md", "ndjson"), default="ndjson")
    g.add_argument("--out", type=filled("--out"), help="a file that isn't there yet")
    g.add_argument("--out-dir", type=filled("--out-dir"), help="a folder for a file for each session")
    return p


def checked(argv: list[str]) -> argparse.Namespace:
    a = parser().parse_args(argv)
    if len(a.input) > 1:
        raise UsageError("expected at most one session log")
    if a.input and not a.input[0].strip():
        raise UsageError("input requires a non-empty path")
    if a.out is not None and a.out_dir is not None:
        raise UsageError("--out and --out-dir cannot be used together")
    if a.since and a.until and a.since > a.until:
        raise UsageError("--since must not be after --until")
    if a.head is not None:
        if len(a.input) != 1:
            raise UsageError("--head requires one session log")
        a.head = a.head.strip()
        if not a.head or a.head == "null":
            raise UsageError("--head requires a non-empty, non-null entry ID")
    return a


def project(folder: str) -> str:
    """The part of a working folder that names the project."""
    m = re.search(r"/src/([^/]+)", folder)
    return m[1] if m else os.path.basename(folder)


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master(os.environ.get("SPARK_MASTER", "local[*]")).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", os.environ.get("SPARK_SHUFFLE_PARTITIONS", "8")).getOrCreate()


def scan(a: argparse.Namespace, spark=None) -> api.Stats:
    registry = default_registry()
    for path in a.adapter:
        if registry.load_file(path) is None:
            raise UsageError(f"--adapter failed to load: {path}")
    if a.source is not None and registry.get(a.source) is None:
        raise UsageError(f"unknown --source: {a.source}")
    scanner = load_scanner(a.scanner) if a.scanner else None
    if a.input:
        paths = [os.path.abspath(a.input[0])]
        if not os.path.isfile(paths[0]):
            raise FileNotFoundError(f"no such file: {a.input[0]}")
    else:
        cwd = None if a.cwd == "all" else a.cwd or project(os.getcwd())
        since = a.since or datetime.now(timezone.utc) - timedelta(days=7)
        paths = list(discover(registry, Search(cwd=cwd, since=since, until=a.until, source=a.source, include_subagents=a.include_subagents)))
    if not paths:
        sinks.apart([], a.out, a.out_dir)
        if a.out:
            sinks.open_new(a.out).close()
        return api.Stats(0, 0, 0)
    criteria = Criteria(a.skill, a.last_turns, a.type, a.role, a.tool, a.error, a.tool_results)
    return api.run(spark or session(), paths, a.source, a.head, criteria, scanner, a.tool_lines, a.no_thinking, a.format, a.out, a.out_dir, registry)


def reason(error: BaseException) -> str:
    """The last line that says why, of a failure in Spark or Python."""
    text = str(error)
    told = re.findall(r"^(?:[\w.]*\.)?(?:MalformedRecord|UnknownFormat|HeadError|HeadPathError): (.*)$", text, re.M)
    return re.sub(r"\s+", " ", told[-1] if told else text.strip().split("\n")[0]).strip()


def main(argv: list[str] | None = None, spark=None) -> int:
    began = time.perf_counter()
    try:
        stats = scan(checked(sys.argv[1:] if argv is None else argv), spark)
    except UsageError as error:
        print(f"sessiondeck: {error}", file=sys.stderr)
        return 2
    except sinks.ClosedOutput:
        return 0
    except Exception as error:
        print(f"sessiondeck: {reason(error)}", file=sys.stderr)
        return 1
    print(f"scanned {stats.sessions_found} sessions, wrote {stats.sessions_written} ({stats.events_written} events) in {time.perf_counter() - began:.2f}s", file=sys.stderr)
    return 0
