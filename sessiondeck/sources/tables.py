"""Tables of events and conversations as canonical events, so that all operators run on them too.

`events`: a user is a session, in order of time; views are users' messages, clicks the assistant's, purchases and errors
results, signups compactions or skills. The number k of the props chooses texts, calls and models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..schema import EVENT_SCHEMA

MESSAGES = (
    "no", "Wrong.", "please just revert it", "you keep doing this!!", "STOPPP it", "why did you remove that??", "looks good, proceed", "are you sure?", "add a test", "what is this?",
    "<command-args>run it now</command-args>", "<command-name>x", "I said\nthat's wrong", "ok\nagain!", "i already said stop changing files", "commit this", "  spaced \t out  ", "undo",
    "you are not listening", "did you check the log", "can you please try again", "instead of that, do this", "seriously?!", "don't change it", "that's not right", "explain the code in detail, thanks",
)
CONTENTS = (
    "File has not been read yet. Read it first", "Exit code 2\nboom", "5 matches for foo", "0 matches", "error: Too many arguments", "<tool_use_error>no</tool_use_error>",
    "ls: cannot access 'x': No such file or directory", "\n\nFAILED tests/a.py\nmore", "all fine\nline two\nline three\nline four", "\x1b[31mred\x1b[0m text", "Process exited with code 3", "workspace-not-found in widget",
)
TOOLS = ("Bash", "Read", "Edit")
NORMALIZED = ("terminal", "file_read", None)
COMMANDS = ("bun test widget", "cat a.txt", "rg --files src", "rg foo", "ls -la", "find . -name x", "echo hi", "widget list")


def conform(rows: DataFrame) -> DataFrame:
    """All columns of the event table, null where rows have none."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in EVENT_SCHEMA.fields], *[c for c in rows.columns if c not in EVENT_SCHEMA.names])


def _pick(values: tuple, at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at.cast("int"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = raw.select(F.col("user_id").cast("string").alias("sid"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("seq"), "event_type", k.alias("k"), F.round(F.col("value") * 100).cast("long").alias("cents"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"))
    k, kind = F.col("k"), F.col("event_type")
    is_user, is_asst, is_result = kind == "view", kind == "click", kind.isin("purchase", "error")
    up = F.when(F.col("seq") % 5 == 3, F.col("seq") - 2).otherwise(F.col("seq") - 1)
    call = lambda n, i: F.struct(F.concat(F.lit("c"), (n % 4).cast("string")).alias("id"), _pick(TOOLS, i % 3).alias("name"), _pick(NORMALIZED, i % 3).alias("normalized_name"), F.concat(F.lit('{"command":"'), _pick(COMMANDS, i % 8), F.lit('"}')).alias("arguments"))
    calls = F.when(k % 10 == 0, F.array(call(k, k), call(k + 1, k + 1))).when(k % 2 == 0, F.array(call(k, k))).otherwise(F.array().cast(T.ArrayType(EVENT_SCHEMA["tool_calls"].dataType.elementType)))
    is_skill = (kind == "signup") & (k % 10 == 0)
    return conform(rows.select(
        "sid", "seq", "timestamp", "k", "cents",
        F.when(is_user, "user_message").when(is_asst, "assistant_message").when(is_result, "tool_result").when(is_skill, "skill_invocation").otherwise("compaction").alias("type"),
        F.concat(F.lit("e"), F.col("seq").cast("string")).alias("id"), F.when(F.col("seq") > 0, F.concat(F.lit("e"), up.cast("string"))).alias("parent_id"),
        F.when(is_user, _pick(MESSAGES, k % len(MESSAGES))).when(is_asst, F.when(k % 3 == 0, F.lit(" ")).otherwise(F.concat(F.lit("reply "), k.cast("string")))).alias("text"),
        F.when(is_asst, F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("m"), (k % 3).cast("string")))).alias("model"),
        F.when(is_asst, calls).alias("tool_calls"),
        F.when(is_asst, F.struct(k.alias("input"), F.col("cents").alias("output"), (k % 7).alias("cache_read"), *[F.lit(None).cast("long").alias(c) for c in ("cache_write", "reasoning_output", "total")], F.lit(None).cast("double").alias("cost_usd"))).alias("usage"),
        F.when(is_skill, F.concat(F.lit("skill"), k.cast("string"))).alias("name"),
        F.when(is_result, F.concat(F.lit("c"), (k % 4).cast("string"))).alias("tool_call_id"), F.when(is_result, F.lit("native")).alias("tool_name"),
        F.when(is_result, _pick(CONTENTS, k % len(CONTENTS))).alias("content"), F.when(is_result, kind == "error").alias("is_error"),
        F.when((kind == "error") & (k % 2 == 0), (k % 5).cast("int")).alias("exit_code"),
    ))


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation are its events; a system's turn is a custom message."""
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    kind = F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "assistant_message").otherwise("custom_message")
    is_custom = kind == "custom_message"
    return conform(raw.select(
        F.col("conv_id").cast("string").alias("sid"), F.col("turn").alias("seq"), kind.alias("type"), F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.lit("").alias("timestamp"),
        F.when(~is_custom, F.col("text")).alias("text"), F.when(is_custom, F.col("text")).alias("content"), F.when(is_custom, F.lit("system")).alias("custom_type"),
        F.when(kind == "assistant_message", F.lit("")).alias("model"), F.when(kind == "assistant_message", F.lit("")).alias("provider"),
        F.when(kind == "assistant_message", F.array().cast(EVENT_SCHEMA["tool_calls"].dataType)).alias("tool_calls"),
    ))


def conversation_logs(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Conversations as native logs of three formats, a row for each: path and content. A system's turn is a compaction.

    claude: every record names its folder, and assistants a model by the conversation. pi: a header of its own, which every
    third conversation lacks; its first record says the model, for every second conversation. codex: a header, and the model in
    a record after it.
    """
    raw = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    sid, conv = F.col("conv_id").cast("string"), F.col("conv_id")
    own, role = F.concat(F.lit("t"), F.col("turn").cast("string")), F.col("role")
    part = F.array(F.struct(F.lit("text").alias("type"), "text"))
    model = F.concat(F.lit("m"), (conv % 3).cast("string"))
    if kind == "claude":
        base = [own.alias("uuid"), sid.alias("sessionId"), F.concat(F.lit("/work/"), sid).alias("cwd"), F.lit("2026-01-01T00:00:00Z").alias("timestamp")]
        user = F.to_json(F.struct(F.lit("user").alias("type"), *base, F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message")))
        reply = F.to_json(F.struct(F.lit("assistant").alias("type"), *base, F.struct(model.alias("model"), part.alias("content")).alias("message")))
        cut = F.to_json(F.struct(F.lit("system").alias("type"), F.lit("compact_boundary").alias("subtype"), *base))
        head = F.lit(None).cast("string")
    elif kind == "codex":
        at = F.lit("2026-03-01T00:00:00Z").alias("timestamp")
        said = lambda who: F.to_json(F.struct(at, F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.lit(who).alias("role"), F.array(F.struct("text")).alias("content")).alias("payload")))
        user, reply, cut = said("user"), said("assistant"), F.to_json(F.struct(F.lit("compacted").alias("type")))
        meta = F.to_json(F.struct(at, F.lit("session_meta").alias("type"), F.struct(sid.alias("id"), F.concat(F.lit("/work/"), sid).alias("cwd"), F.lit("cli").alias("originator")).alias("payload")))
        head = F.concat_ws("\n", meta, F.to_json(F.struct(F.lit("turn_context").alias("type"), F.struct(model.alias("model")).alias("payload"))))
    else:
        base = [own.alias("id"), F.lit("").alias("timestamp")]
        user = F.to_json(F.struct(F.lit("message").alias("type"), *base, F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message")))
        reply = F.to_json(F.struct(F.lit("message").alias("type"), *base, F.struct(F.lit("assistant").alias("role"), model.alias("model"), part.alias("content")).alias("message")))
        cut = F.to_json(F.struct(F.lit("compaction").alias("type"), *base, F.lit("so far").alias("summary")))
        session = F.to_json(F.struct(F.lit("session").alias("type"), sid.alias("id"), F.concat(F.lit("/work/"), sid).alias("cwd")))
        change = F.to_json(F.struct(F.lit("model_change").alias("type"), F.lit("mc").alias("id"), F.lit("acme").alias("provider"), model.alias("modelId")))
        head = F.nullif(F.concat_ws("\n", F.when(conv % 3 != 0, session), F.when(conv % 2 == 0, change)), F.lit(""))
    line = F.when(role == "user", user).when(role == "assistant", reply).otherwise(cut)
    lines = raw.select("conv_id", "turn", line.alias("line"), head.alias("head")).groupBy("conv_id").agg(F.first("head").alias("head"), F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("lines"))
    body = F.concat_ws("\n", "head", F.array_join(F.col("lines.line"), "\n"))
    return lines.select(F.concat(F.lit("/logs/"), F.col("conv_id").cast("string"), F.lit(".jsonl")).alias("path"), body.cast("binary").alias("content"))
