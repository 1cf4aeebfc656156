"""Events as lines of JSON or as Markdown, in column `line`.

A field that an event doesn't have is left out; one that it has without a value is null: the parent of all but headers, and
the text of thinking that wasn't recorded. What a scanner adds to an event comes last, and its `sid` goes before the session's.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import yaml
from .functions.text import quoted, truncate_line
from .schema import FIELDS

_USAGE = (("input", "input"), ("output", "output"), ("cacheRead", "cache_read"), ("cacheWrite", "cache_write"), ("reasoningOutput", "reasoning_output"), ("total", "total"), ("costUsd", "cost_usd"))


def _field(key: str, value: Column) -> Column:
    """`"key":value`, null if the value is."""
    made = F.to_json(F.struct(value.alias(key)))
    return F.when(value.isNotNull(), F.substring(made, F.lit(2), F.length(made) - 2))


def _raw(key: str, json: Column) -> Column:
    return F.concat(F.lit(f'"{key}":'), json)


def _object(*fields: Column) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))


def _call(c: Column) -> Column:
    return _object(_field("id", c["id"]), _field("name", c["name"]), _raw("arguments", c["arguments"]), _field("normalizedName", c["normalized_name"]))


def _fields() -> dict[str, Column]:
    is_start = F.col("type") == "session_start"
    out = {key: _field(key, F.col(name)) for key, (name, _) in FIELDS.items()}
    out["parentId"] = F.when(~is_start, _raw("parentId", F.coalesce(F.to_json(F.col("parent_id").cast("variant")), F.lit("null"))))
    out["path"] = F.when(is_start, out["path"])
    out["thinking"] = F.when(F.col("thinking").isNotNull(), _raw("thinking", _object(_field("summary", F.col("thinking.summary")), F.coalesce(_field("text", F.col("thinking.text")), F.lit('"text":null')))))
    out["usage"] = F.when(F.col("usage").isNotNull(), _raw("usage", _object(*[_field(key, F.col("usage")[name]) for key, name in _USAGE])))
    out["toolCalls"] = F.when(F.col("tool_calls").isNotNull(), F.concat(F.lit('"toolCalls":['), F.array_join(F.transform("tool_calls", _call), ","), F.lit("]")))
    out["arguments"] = _raw("arguments", F.col("arguments"))
    out["content"] = F.coalesce(out["content"], _raw("content", F.col("content_json")))
    return out


def _extra() -> Column:
    """The fields of an extra object, without its braces."""
    return F.when(F.col("extra").isNotNull() & (F.col("extra") != "{}"), F.substring("extra", F.lit(2), F.length("extra") - 2))


def ndjson(events: DataFrame) -> DataFrame:
    own = F.coalesce(F.get_json_object("extra", "$.sid"), F.col("sid"))
    return events.withColumn("line", _object(_field("sid", own), *_fields().values(), _extra()))


@F.pandas_udf(T.StringType())
def _yaml(values: pd.Series) -> pd.Series:
    return values.map(yaml.from_json, na_action="ignore")


def _summary(c: Column) -> Column:
    """What a call is about: the first of some arguments that is set, or all."""
    v = F.try_parse_json(c["arguments"])
    found = F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in (F.try_variant_get(v, f"$.{k}", "variant") for k in ("command", "cmd", "file_path", "path", "pattern"))])
    said = F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(found, "$", "string"))
    return truncate_line(F.coalesce(said, c["arguments"]), 100)


def _some(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def _paragraphs(*parts: Column) -> Column:
    return F.concat_ws("\n\n", *parts)


def _fenced(body: Column, kind: str = "") -> Column:
    return F.concat(F.lit(f"```{kind}\n"), body, F.lit("\n```"))


def markdown(events: DataFrame) -> DataFrame:
    """Each event's block, with two line feeds after it."""
    kind, text = F.col("type"), lambda c: F.coalesce(F.col(c), F.lit(""))
    f = _fields()
    is_other = ~kind.isin("session_start", "user_message", "assistant_message", "skill_invocation", "tool_result", "compaction", "error")
    rest = _object(*[f[k] for k in f if k not in ("type", "id", "parentId", "timestamp", "customType")], _extra())
    events = events.withColumn("_yaml", _yaml(F.when(is_other, rest).when((kind == "skill_invocation") & (F.col("arguments") != "{}"), F.col("arguments"))))
    about = F.concat_ws(" · ", _some(F.col("cwd")), _some(F.col("model")), _some(F.col("timestamp")))
    calls = F.transform("tool_calls", lambda c: F.concat(F.lit("→ **"), F.coalesce(c["normalized_name"], c["name"]), F.lit("** `"), _summary(c), F.lit("`")))
    title = F.concat(F.lit("### "), kind, F.coalesce(F.concat(F.lit(" · "), _some(F.col("custom_type"))), F.lit("")))
    block = (
        F.when(kind == "session_start", _paragraphs(F.concat(F.lit("# session "), F.coalesce(_some(F.col("id")), F.col("sid"))), _some(about)))
        .when(kind == "user_message", F.concat(F.lit("## user\n\n"), text("text")))
        .when(kind == "assistant_message", _paragraphs(
            F.concat(F.lit("## assistant"), F.coalesce(F.concat(F.lit(" ("), _some(F.col("model")), F.lit(")")), F.lit(""))),
            quoted(_some(F.col("thinking.text"))), _some(F.col("text")), _some(F.array_join(calls, "\n\n")),
        ))
        .when(kind == "skill_invocation", _paragraphs(F.concat(F.lit("### skill · "), text("name")), F.concat(F.lit("`"), _some(F.col("path")), F.lit("`")), _fenced(_some(F.col("_yaml")), "yaml")))
        .when(kind == "tool_result", F.concat(F.lit("### tool_result"), F.when(F.col("is_error"), F.lit(" [error]")).otherwise(F.lit("")), F.lit("\n\n"), _fenced(text("content"))))
        .when(kind == "compaction", F.concat(F.lit("--- compaction"), F.coalesce(F.concat(F.lit(": "), _some(F.col("summary"))), F.lit("")), F.lit(" ---")))
        .when(kind == "error", F.concat(F.lit("### error\n\n"), text("message")))
        .otherwise(_paragraphs(title, _fenced(_some(F.col("_yaml")), "yaml")))
    )
    return events.withColumn("line", F.concat(block, F.lit("\n\n"))).drop("_yaml")
