"""The reports: lengths of segments, first turns, and a session's phases."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import sinks
from ..functions.classify import error_name, primary_argument, user_intent
from ..functions.text import one_line
from ..operators import aggregates as agg, joins
from ..sources import tables
from ..sources.formats.base import joined_text, number, record, string
from ..sources.json_values import lenient_lines
from ..sources.logs import local_name, read_logs

BRANCH = r"^--.*-(feat|fix)-(.+)--$"
ROW = "sid string, seq long, type string, text string, tool_calls array<struct<id:string,name:string,normalized_name:string,arguments:string>>, usage struct<input:bigint,output:bigint,cache_read:bigint,cache_write:bigint,reasoning_output:bigint,total:bigint,cost_usd:double>, branch_type string, branch string, started_at string"
COLLATION = "UNICODE"
KEYS = ("branch_type", "branch", "session", "started_at", "segment")


def branch_of(path: str, pattern: str = BRANCH) -> tuple[str, str] | None:
    m = re.match(pattern, os.path.basename(os.path.dirname(path)))
    return (m[1], m[2]) if m else None


def branch_events(spark: SparkSession, paths: str | list[str], pattern: str = BRANCH) -> DataFrame:
    """Messages and compactions of logs in folders that name a branch. Lines that aren't JSON are left out, and so is a log in which something comes before the header."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(ROW)
    kind = to_arrow_schema(schema)

    def rows(path: str, text: str):
        branch = branch_of(path, pattern)
        started = None
        sid, seq = os.path.basename(path).removesuffix(".jsonl"), 0
        out: list[dict[str, Any]] = []
        for raw in map(record, lenient_lines(text) if branch else ()):
            message = record(raw.get("message"))
            role = message.get("role")
            if raw.get("type") == "session":
                started = string(raw["timestamp"]) if raw.get("timestamp") is not None else ""
                continue
            if started is None:
                break
            content = message.get("content")
            base = {"sid": sid, "seq": seq, "text": None, "tool_calls": None, "usage": None}
            if raw.get("type") == "compaction":
                out.append(base | {"type": "compaction"})
            elif raw.get("type") == "message" and role in ("user", "toolResult"):
                out.append(base | {"type": "user_message" if role == "user" else "tool_result"})
            elif raw.get("type") == "message" and role == "assistant":
                calls = [b for b in map(record, content if isinstance(content, list) else []) if b.get("type") == "toolCall"]
                u = record(message.get("usage"))
                usage = {"input": number(u.get("input")), "output": number(u.get("output")), "cache_read": number(u.get("cacheRead"))}
                out.append(base | {"type": "assistant_message", "text": joined_text(content), "tool_calls": [{"id": c.get("id"), "name": c.get("name")} for c in calls], "usage": usage})
            else:
                continue
            seq += 1
        if started is not None:
            # a header row, so that a log without messages still has its one segment
            yield {"sid": sid, "seq": -1, "type": "session_start", "branch_type": branch[0], "branch": branch[1], "started_at": started}
            yield from (r | {"branch_type": branch[0], "branch": branch[1], "started_at": started} for r in out)

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found = list(rows(local_name(path), (content or b"").decode("utf-8", "replace")))
                if found:
                    yield pa.RecordBatch.from_pylist(found, kind)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(paths).select("path", "content")
    return tables.conform(files.mapInArrow(parse, schema))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*[F.collate(c, COLLATION) for c in ("branch_type", "branch", "started_at")], "segment")


def session_lengths(events: DataFrame) -> DataFrame:
    """Counts of all segments, in the report's order."""
    rows = agg.segment_counts(events, "branch_type", "branch", "started_at").withColumnRenamed("sid", "session")
    return _sorted(rows.select(*KEYS, "user", "assistant_text", "tool_call", "tool_result", "tokens_in", "tokens_out"))


def first_turn_lengths(events: DataFrame) -> DataFrame:
    rows = agg.first_turns(events, "branch_type", "branch", "started_at").withColumnRenamed("sid", "session")
    return _sorted(rows.select(*KEYS, *agg.FIRST_TURN))


def thousands(x: float) -> str:
    return f"{int(x + 0.5) if x >= 0 else -int(0.5 - x):,}"


def first_turn_report(events: DataFrame, generated: str) -> str:
    """Markdown: totals, distributions of all turns and by kind of branch, and the longest."""
    rows = first_turn_lengths(events).cache()
    dist = {(r["name"], r["metric"]): r for r in agg.distribution(rows, group="branch_type").collect()}  # a row for each metric and kind
    total = agg.totals(rows).first()
    top = agg.longest(rows, KEYS).collect()
    rows.unpersist()
    n = {k: dist[k, "output_tokens"]["n"] if (k, "output_tokens") in dist else 0 for k in ("All", "feat", "fix")}

    def block(name: str) -> str:
        lines = [f"### {name} (n={n[name]} first-turns)", "", "| metric | mean | p50 | p90 | p99 | max |", "|---|---:|---:|---:|---:|---:|"]
        for metric in ("output_tokens", "input_tokens", "cache_read", "asst_turns", "tool_calls"):
            r = dist.get((name, metric))
            lines.append(f"| {metric} | " + " | ".join(thousands(r[c]) if r else "0" for c in ("mean", "p50", "p90", "p99", "max")) + " |")
        return "\n".join(lines)

    table = ["| # | type | branch | started_at | seg | asst_turns | tool_calls | output_tokens |", "|---|---|---|---|---:|---:|---:|---:|"]
    table += [f"| {i} | {r['branch_type']} | {r['branch']} | {r['started_at']} | {r['segment']} | {r['asst_turns']} | {r['tool_calls']} | {thousands(r['output_tokens'])} |" for i, r in enumerate(top, 1)]
    head = ["# First turns of sessions", "", f"Generated: {generated}", "", "A first turn runs from a segment's first user message to the next one; a segment ends with a compaction.", "Turns without an answer are left out.", "", "## Totals", ""]
    head += [f"- first-turns analyzed: **{n['All']}** (feat: {n['feat']}, fix: {n['fix']})", f"- combined output tokens: **{thousands(total['output_tokens'])}**", f"- combined fresh input tokens: **{thousands(total['input_tokens'])}**", f"- combined cache_read tokens: **{thousands(total['cache_read'])}**"]
    return "\n\n".join(["\n".join(head), block("All"), block("feat"), block("fix"), "## Top 10 longest first-turns by output_tokens", "\n".join(table)]) + "\n"


#: Fixed values of the session report: notes on agents, by a word of their label or by their role; the mark of what a person has yet to write; and the headings of the last section.
NOTES = {
    "ORPHANED": "reviewer **orphaned** — process exited; verdict never consumed by parent.",
    "WATCHDOG": "implementer **watchdog-killed** mid-run; a retry agent re-did the work.",
    "fix": "is a **fix wave** — the preceding review found problems that needed correcting.",
}
PENDING = "<!-- pending -->"
NARRATIVE = ("\n## Narrative & assessment\n", "### What went well", "### Where the agent went off (root causes)", "### Reviewer verdicts (per task)", "### Recommendations")


@dataclass(frozen=True)
class Phase:
    title: str
    ids: tuple[str, ...] = ()
    low: str | None = None
    high: str | None = None


@dataclass(frozen=True)
class Config:
    """What a session report is about. Paths are relative to the file it was read from."""

    title: str
    export_dir: str
    out: str
    main_id: str
    subtitle: str = ""
    outcome: tuple[str, ...] = ()
    path_strip: dict[str, str] = field(default_factory=dict)
    agents: dict[str, tuple[str, str]] = field(default_factory=dict)
    phases: tuple[Phase, ...] = ()

    @classmethod
    def read(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            c = json.load(f)
        base = os.path.dirname(os.path.abspath(path))
        phases = tuple(Phase(p["title"], tuple(p.get("ids", ())), *p.get("win", (None, None))) for p in c["phases"])
        return cls(c["title"], os.path.join(base, c["exportDir"]), os.path.join(base, c["out"]), c["mainId"], c.get("subtitle") or "", tuple(c.get("outcome") or ()), dict(c.get("pathStrip") or {}), {k: tuple(v) for k, v in c.get("agents", {}).items()}, phases)


def phase_calls(events: DataFrame, strip: dict[str, str]) -> DataFrame:
    """All calls with what they were about, and the class of their error if they failed."""
    bad = F.coalesce(F.col("result.is_error"), F.lit(False))
    made = joins.calls_with_results(events, "timestamp")
    return made.select("sid", "seq", "pos", F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.coalesce("name", F.lit("?")).alias("name"), one_line(primary_argument("arguments", strip)).alias("arg"), F.when(bad, error_name(F.col("result.content"), F.col("result.exit_code"))).alias("error"))


def phase_rows(config: Config, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls of each phase, with the list they are in (0: the main thread, else the agent's place), and the main thread's users' messages by phase."""
    spark = events.sparkSession
    times = spark.createDataFrame([(i, p.low, p.high) for i, p in enumerate(config.phases)], "phase long, low string, high string")
    agents = spark.createDataFrame([(i, k, sid) for i, p in enumerate(config.phases) for k, sid in enumerate(p.ids, 1)], "phase long, place long, sid string")
    bounded = times.where("coalesce(low, '') != '' or coalesce(high, '') != ''")
    calls = phase_calls(events, config.path_strip)
    main = joins.by_phase(calls.where(F.col("sid") == config.main_id), bounded).withColumn("place", F.lit(0).cast("long")).drop("low", "high")
    sub = calls.join(F.broadcast(agents), "sid")
    asked = events.where((F.col("sid") == config.main_id) & (F.col("type") == "user_message")).select("seq", "timestamp", user_intent("text").alias("said"))
    return main.unionByName(sub), joins.by_phase(asked, times).select("phase", "seq", "said.intent", "said.text")


def session_report(config: Config, events: DataFrame) -> str:
    """Markdown: each phase's agents, what users said, calls, and the errors of all lists."""
    events = events.cache()
    calls, said = (x.cache() for x in phase_rows(config, events))
    named = {sid for p in config.phases for sid in p.ids} | {config.main_id}
    few = events.where(F.col("sid").isin(sorted(named)))
    stats = {r["sid"]: r for r in agg.session_stats(few).collect()}
    models = {r["sid"]: r["model"] for r in few.where("type = 'session_start'").groupBy("sid").agg(F.first("model").alias("model")).collect()}
    span = events.agg(F.min(F.nullif("timestamp", F.lit(""))).alias("a"), F.max(F.nullif("timestamp", F.lit(""))).alias("b")).select(agg.span_text(F.col("a"), F.col("b"))).first()[0]
    sessions = events.select("sid").distinct().count()
    counts: dict[tuple[int, int], list] = {}
    for r in calls.groupBy("phase", "place", "name").agg(F.count("*").alias("n"), F.min(F.struct("seq", "pos")).alias("at")).orderBy("phase", "place", F.col("n").desc(), "at").collect():
        counts.setdefault((r["phase"], r["place"]), []).append((r["name"], r["n"]))
    bad: dict[tuple[int, int], list] = {}
    for r in calls.where(F.col("error").isNotNull()).orderBy("phase", "place", "seq", "pos").collect():
        bad.setdefault((r["phase"], r["place"]), []).append(r)
    people: dict[int, list] = {}
    for r in said.orderBy("phase", "seq").collect():
        people.setdefault(r["phase"], []).append(f"- **[{r['intent']}]** {r['text']}")

    def numbers(sid: str) -> tuple[int, int, int]:
        r = stats.get(sid)
        return (r["asst"], r["tools"], r["errs"]) if r else (0, 0, 0)

    def listed(key: tuple[int, int], title: str) -> list[str]:
        if key not in counts:
            return []
        out = [f"{title} ({sum(n for _, n in counts[key])})", "`" + "  ".join(f"{name} ×{n}" for name, n in counts[key]) + "`"]
        if key in bad:
            out += [f"\nfailed ({len(bad[key])}):", "```", *(f"{r['name']:<7} {r['arg']}  ❌ {r['error']}" for r in bad[key]), "```"]
        return out

    asst, tools, errs = numbers(config.main_id)
    lines = [f"# {config.title}\n", *([f"{config.subtitle}\n"] if config.subtitle else []), "## Outcome\n", *(f"- {x}" for x in config.outcome)]
    lines += [f"- **Wall-clock:** {span}.", f"- **Sessions:** {sessions} (1 main + {sessions - 1} sub-agents).", f"- **Main thread:** {asst} assistant turns, {tools} tool calls, {errs} tool errors.\n"]
    for i, p in enumerate(config.phases):
        lines.append(f"\n## {p.title}\n")
        notes = []
        if p.ids:
            lines.append("**Agents**")
        for sid in p.ids:
            role, label = config.agents.get(sid, ("?", sid))
            a, t, e = numbers(sid)
            lines.append(f"- `{sid[:12]}` [{role}] {label} — {models.get(sid) or '?'} ({a} turns, {t} tools{f', {e} errors' if e else ''})")
            shows = {"ORPHANED": "ORPHANED" in label, "WATCHDOG": "WATCHDOG" in label, "fix": role == "fix"} if sid in config.agents else {}
            notes += [f"`{sid[:12]}` {text}" for what, text in NOTES.items() if shows.get(what)]
        lines += [""] if p.ids else []
        lines += ["**What went wrong / went off**", *(f"- {x}" for x in notes), ""] if notes else []
        lines += ["**Human**", *people[i], ""] if i in people else []
        lines += listed((i, 0), "**Main-thread tool calls**")
        for k, sid in enumerate(p.ids, 1):
            lines += listed((i, k), f"**`{sid[:12]}` [{config.agents.get(sid, ('?', ''))[0]}] tool calls**")
        lines += ["\n### Assessment", PENDING]
    tally = calls.where(F.col("error").isNotNull()).groupBy("error").agg(F.count("*").alias("n"), F.min(F.struct("phase", "place", "seq", "pos")).alias("at")).orderBy(F.col("n").desc(), "at").collect()
    lines += ["\n## Error summary\n", "| error name | count |", "|---|--:|", *(f"| {r['error']} | {r['n']} |" for r in tally), f"| **total** | **{sum(r['n'] for r in tally)}** |"]
    lines.append(NARRATIVE[0])
    for title in NARRATIVE[1:]:
        lines += [title, f"{PENDING}\n"]
    for x in (events, calls, said):
        x.unpersist()
    return "\n".join(lines)


def read_export(spark: SparkSession, config: Config) -> DataFrame:
    """The main thread and its sub-agents' logs."""
    folder = os.path.join(config.export_dir, "subagents")
    subs = sorted(os.path.join(folder, x) for x in os.listdir(folder) if x.endswith(".jsonl")) if os.path.isdir(folder) else []
    return read_logs(spark, [os.path.join(config.export_dir, "main-thread.jsonl"), *subs])


def write_session_report(spark: SparkSession, path: str) -> str:
    config = Config.read(path)
    text = session_report(config, read_export(spark, config))
    with open(config.out, "w", encoding="utf-8") as f:
        f.write(text)
    return config.out


def write_first_turn_reports(spark: SparkSession, paths: str | list[str], folder: str, generated: str, pattern: str = BRANCH) -> list[str]:
    events = branch_events(spark, paths, pattern)
    made = [os.path.join(folder, x) for x in ("first-turn-lengths.tsv", "session-lengths.tsv", "session-lengths-report.md")]
    sinks.write_tsv(first_turn_lengths(events), made[0])
    sinks.write_tsv(session_lengths(events), made[1])
    with sinks.open_new(made[2]) as f:
        f.write(first_turn_report(events, generated))
    return made

