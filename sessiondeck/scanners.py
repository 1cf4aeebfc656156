"""Scanners: what they find in sessions takes the place of the sessions' events.

A scanner is a function from events (without headers) and headers to rows. Those here are whole DataFrame plans; per_session()
makes one of a Python function over one session's events, for what has no plan.
"""

from __future__ import annotations

import importlib.util
import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .functions.classify import command_of, mentions
from .functions.text import blank, first_filled_line, truncate
from .operators import aggregates, context as ctx, joins
from .schema import EVENT_SCHEMA, FIELDS, dumps

Scanner = Callable[[DataFrame, DataFrame], DataFrame]
KINDS = ("tool_error", "bash_error", "test_failure")
SIGNALS = ("correction", "repeated_instruction", "frustration")


@dataclass(frozen=True)
class Target:
    """What a tool's failures are known by: beginnings and parts of commands and outputs, in any case; and of tests."""

    prefix: str
    parts: tuple[str, ...] = ()
    test_commands: tuple[str, ...] = ()
    test_outputs: tuple[str, ...] = ()
    name: str = "failures"


def _context(events: DataFrame) -> DataFrame:
    return events if "turn_no" in events.columns else ctx.with_context(events)


def _any(text: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(text.contains(p), F.lit(False))
    return out


def failures(events: DataFrame, target: Target) -> DataFrame:
    """The failed results whose command or output mentions the target, with what was going on."""
    prompt = F.when(F.col("turn_no") > 0, F.first("text").over(ctx.turn()))  # a turn begins with its user's message
    found = joins.with_call_in_turn(ctx.with_prior(_context(events), aggregates.failed(), "prior_errors").withColumn("_prompt", prompt))
    found = found.where(aggregates.failed()).withColumn("command", command_of("call.arguments"))
    hit = mentions("command", list(target.parts), target.prefix) | mentions("content", list(target.parts), target.prefix)
    is_test = _any(F.col("command"), target.test_commands) | _any(F.col("content"), target.test_outputs)
    is_shell = F.coalesce(F.col("call.normalized_name") == "terminal", F.lit(False)) | F.col("exit_code").isNotNull()
    return (
        found.where(hit)
        .withColumn("kind", F.when(is_test, "test_failure").when(is_shell, "bash_error").otherwise("tool_error"))
        .withColumn("error_text", truncate("content"))
        .withColumn("user_prompt", F.when(F.col("_prompt") != "", truncate("_prompt", 200)))
        .withColumn("finding_summary", truncate(first_filled_line("content"), 120))
        .drop("_prompt", "call")
    )


def summary(events: DataFrame, found: DataFrame) -> DataFrame:
    """Findings by kind for each session, zeros if it has none."""
    counts = found.groupBy("sid").agg(F.count("*").alias("findings"), *[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    return events.select("sid").distinct().join(counts, "sid", "left").fillna(0, ["findings", *KINDS])


def failure_scanner(target: Target) -> Scanner:
    """Each finding with all its event's fields, and a summary as each session's last row."""

    def scan(events: DataFrame, starts: DataFrame) -> DataFrame:
        found = failures(events, target)
        told = F.struct(F.lit(target.name).alias("scanner"), "kind", "command", F.col("tool_name").alias("toolName"), F.col("error_text").alias("errorText"), F.col("user_prompt").alias("userPrompt"), F.col("prior_errors").alias("priorErrorsInTurn"), F.col("finding_summary").alias("summary"))
        rows = found.withColumn("extra", F.to_json(F.struct(told.alias("finding")))).select(*EVENT_SCHEMA.names)
        ends = starts.select("sid", "seq", "id", "cwd").join(summary(starts.select("sid"), found), "sid")
        extra = F.to_json(F.struct(F.lit(target.name).alias("scanner"), F.col("id").alias("sessionId"), "cwd", "findings", F.struct(*KINDS).alias("byKind")))
        last = ends.select("sid", (F.col("seq") + F.lit((1 << 31) - 1)).alias("seq"), F.lit("custom_message").alias("type"), F.lit("scan_summary").alias("custom_type"), extra.alias("extra"))
        return rows.unionByName(last, allowMissingColumns=True)

    return scan


def scored(events: DataFrame, scorer: Callable[[Column, Column], Column], max_chars: int = 8000, threshold: float = 0.8) -> DataFrame:
    """Users' messages with a signal of probability >= threshold.

    scorer: an expression (a pandas UDF, say) from the message and the last reply of the turn before, both cut to max_chars
    (the reply null if there is none), to a map from signal to probability. A probability that isn't in 0..1 is an error.
    """
    asked = ctx.with_previous_reply(_context(events)).where(~blank("text"))
    reply = F.coalesce("previous_reply", F.lit(""))
    cut = F.struct((F.length("text") > max_chars).alias("current_message"), (F.length(reply) > max_chars).alias("previous_message"))
    p = scorer(F.substring("text", 1, max_chars), F.nullif(F.substring(reply, 1, max_chars), F.lit("")))
    rows = asked.withColumn("truncated", cut).withColumn("probabilities", p)
    bad = F.exists(F.map_values("probabilities"), lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    rows = rows.withColumn("probabilities", F.when(F.col("probabilities").isNull() | bad, F.raise_error(F.lit("the scorer returned an invalid probability"))).otherwise(F.col("probabilities")))
    flags = F.array_sort(F.map_keys(F.map_filter("probabilities", lambda k, v: v >= threshold)))
    return rows.withColumn("flags", flags).where(F.size("flags") > 0)


def scoring_scanner(scorer: Callable[[Column, Column], Column], model: str, name: str = "corrections", max_chars: int = 8000, threshold: float = 0.8) -> Scanner:
    """Flagged messages with the finding; of the event, only what a user wrote."""

    def scan(events: DataFrame, starts: DataFrame) -> DataFrame:
        rows = scored(events, scorer, max_chars, threshold)
        told = F.struct(F.lit(name).alias("scanner"), F.lit(model).alias("model"), "flags", "probabilities", F.lit(threshold).alias("threshold"), F.struct(F.col("truncated.current_message").alias("currentMessage"), F.col("truncated.previous_message").alias("previousAssistantMessage")).alias("truncated"))
        return rows.select("sid", "seq", "type", "id", "parent_id", "timestamp", "text", F.to_json(F.struct(told.alias("finding"))).alias("extra"))

    return scan


def parse_answer(value: Any, signals: Iterable[str] = SIGNALS) -> tuple[str, dict[str, float]]:
    """Model and probabilities from a scoring service's answer."""
    answers = value.get("answers") if isinstance(value, dict) else None
    if not isinstance(answers, dict) or not isinstance(value.get("model"), str) or not value["model"]:
        raise ValueError("the scorer returned an invalid answer")
    out = {}
    for s in signals:
        a = answers.get(s)
        p = a.get("noul") if isinstance(a, dict) and a.get("type") == "noul" else None
        if isinstance(p, bool) or not isinstance(p, (int, float)) or not math.isfinite(p) or not 0 <= p <= 1:
            raise ValueError(f"the scorer returned an invalid probability for {s}")
        out[s] = float(p)
    return value["model"], out


def per_session(function: Callable[[list[dict[str, Any]], dict[str, Any]], Iterator[dict[str, Any]]]) -> Scanner:
    """A scanner from a function that is called once for each session, with its events in order and its header, and gives rows: `type`, and any other fields."""
    names = {key: name for key, (name, _) in FIELDS.items()}

    def scan(events: DataFrame, starts: DataFrame) -> DataFrame:
        both = starts.select(*EVENT_SCHEMA.names).withColumn("_start", F.lit(True)).unionByName(events.select(*EVENT_SCHEMA.names).withColumn("_start", F.lit(False)))

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = json.loads(pdf.sort_values("seq").to_json(orient="records"))
            header = next((r for r in rows if r["_start"]), {})
            made = []
            for i, found in enumerate(function([r for r in rows if not r["_start"]], header)):
                row = dict.fromkeys(EVENT_SCHEMA.names) | {"sid": pdf["sid"].iloc[0], "seq": header.get("seq", 0) + 1 + i, "type": found["type"]}
                for key in ("id", "timestamp", "text", "customType", "parentId"):
                    row[names[key]] = found.get(key)
                row["extra"] = dumps({k: v for k, v in found.items() if k not in ("type", "id", "timestamp", "text", "customType", "parentId")})
                made.append(row)
            return pd.DataFrame(made, columns=EVENT_SCHEMA.names)

        return both.groupBy("sid").applyInPandas(one, EVENT_SCHEMA)

    return scan




def load_scanner(path: str) -> Scanner:
    """A module's `scan`, or its `scan_session` over one session's events."""
    spec = importlib.util.spec_from_file_location("sessiondeck_scanner", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"can't load scanner: {path}")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    whole, one = getattr(module, "scan", None), getattr(module, "scan_session", None)
    if callable(whole):
        return whole
    if callable(one):
        return per_session(one)
    raise ValueError(f"scanner has no function scan or scan_session: {path}")
