import json

import duckdb
import pytest
from pyspark.sql import functions as F

from sessiondeck import api, render, scanners, yaml
from sessiondeck.functions import classify, sentiment, text as tx
from sessiondeck.operators import aggregates as agg, context as ctx, joins, select as sel
from sessiondeck.plans import queries
from sessiondeck.sources import tables
from sessiondeck.sources.logs import read_logs

from . import samples

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def logs(spark, tmp_path_factory):
    return read_logs(spark, list(samples.all_logs(str(tmp_path_factory.mktemp("logs"))).values())).cache()


def ids(df, sid="p1"):
    return [r["id"] for r in df.where(F.col("sid") == sid).orderBy("seq").collect()]


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v string").select(make("v").alias("x")).first()["x"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_says_the_same(spark, name):
    c = duckdb.connect()
    for t in ("documents", "events", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.project(", ".join(f'"{c}"' for c in cols)).fetchall()))


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_context_of_a_log(logs):
    rows = {r["id"]: r for r in ctx.with_context(logs).where("sid = 'p1'").collect()}
    assert [rows[i]["turn_no"] for i in ("p1", "m", "u1", "a1", "k1", "u2", "a2")] == [0, 0, 1, 1, 1, 2, 2]
    assert (rows["p1"]["active_model"], rows["u2"]["active_model"], rows["a2"]["active_model"]) == ("big", "big", "small")
    assert (rows["b1"]["segment"], rows["u2"]["segment"]) == (0, 1)


def test_a_second_header_begins_anew(spark):
    rows = [("s", i, t, "x") for i, t in enumerate(["session_start", "user_message", "compaction", "session_start", "user_message"])]
    got = ctx.with_context(tables.conform(spark.createDataFrame(rows, "sid string, seq long, type string, model string"))).orderBy("seq").collect()
    assert [(r["run_no"], r["turn_no"], r["segment"]) for r in got] == [(1, 0, 0), (1, 1, 0), (1, 1, 1), (2, 0, 0), (2, 1, 0)]


@pytest.mark.parametrize("block_rows", [1, 3, 7, 1000])
def test_context_by_blocks_is_the_same(spark, logs, block_rows):
    more = tables.user_events(spark, SF).withColumn("type", F.when(F.col("k") % 9 == 4, "session_start").otherwise(F.col("type")))
    for df in (logs, more.select(*logs.columns)):
        keep = ["sid", "seq", "run_no", "turn_no", "active_model", "segment"]
        assert sorted(ctx.with_context(df, block_rows).select(keep).collect()) == sorted(ctx.with_context(df).select(keep).collect())


def test_filters_of_a_log(logs):
    keep = lambda **c: ids(sel.filter_events(logs, sel.Criteria(**c)))
    assert keep(last_turns=1) == ["p1", "u2", "a2", "alt"]
    assert keep(types=("user_message",)) == ["p1", "u1", "u2"] and keep(roles=("tool_result",)) == ["p1", "r1"]
    assert keep(error=True) == ["p1", "r1"] and keep(tools=("terminal",)) == ["p1", "a1", "r1"] and keep(tools=("file_read",)) == ["p1"]
    assert keep(skills=("nope",)) == [] and keep(skills=("deploy",), error=True, last_turns=1) == ["p1"]
    claude = ids(sel.filter_events(logs, sel.Criteria(tools=("terminal",))), "s1")
    assert claude == ["s1", "a1", "u2:t1"]
    for bad in ({"last_turns": 0}, {"last_turns": True}, {"types": ("x",)}, {"roles": ("x",)}, {"tool_results": "x"}):
        with pytest.raises(ValueError):
            sel.Criteria(**bad)
    assert not sel.Criteria().any() and sel.Criteria(error=True).any()


def test_trim(logs):
    got = {r["id"]: r for r in sel.trim(logs, 1, True).collect()}
    assert got["r1"]["content"] == "FAILED widget" and got["a1"]["thinking"] is None and got["b1"]["content"] == "$ ls (exit 0)"
    assert {r["content"] for r in sel.trim(logs, 0).where("type = 'tool_result'").collect()} == {""}


def test_head_path(spark):
    edges = [("s", "a", None, 0), ("s", "b", "a", 1), ("s", "c", "a", 2), ("s", "d", "b", 3), ("t", "x", "gone", 0), ("t", "y", "x", 1)]
    entries = spark.createDataFrame(edges, "sid string, id string, parent_id string, seq long")
    heads = spark.createDataFrame([("s", "d"), ("t", "y")], "sid string, head string")
    assert [(r["sid"], r["id"]) for r in sel.head_path(entries, heads).orderBy("sid", "seq").collect()] == [("s", "a"), ("s", "b"), ("s", "d"), ("t", "x"), ("t", "y")]
    long = spark.range(300).select(F.lit("s").alias("sid"), F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"), F.col("id").alias("seq"))
    assert sel.head_path(long, spark.createDataFrame([("s", "250")], "sid string, head string")).count() == 251
    cycle = spark.createDataFrame([("s", "a", "b", 0), ("s", "b", "c", 1), ("s", "c", "a", 2)], entries.schema)
    for bad, head, why in ((cycle, "a", "cycle"), (entries, "zz", "not found"), (entries.unionAll(entries), "d", "duplicate")):
        with pytest.raises(sel.HeadPathError, match=why):
            sel.head_path(bad, spark.createDataFrame([("s", head)], "sid string, head string"))


def test_admission_and_headers(spark, logs):
    headless = logs.where("type != 'session_start'")
    assert sel.admitted(headless).count() == 0 and sel.admitted(logs).count() == logs.count()
    assert {r["sid"] for r in sel.in_folder_and_time(logs, cwd="WORK/p").collect()} == {"p1"}
    assert "p1" not in {r["sid"] for r in sel.in_folder_and_time(logs, since="2026-02-15").collect()}
    assert joins.sub_sessions(logs).count() == 0


def test_sentiment_and_text(spark):
    f = lambda t, n=None: (lambda r: (r["score"], r["signals"]))(one(spark, t, lambda c: sentiment.frustration(c, None if n is None else F.lit(n))))
    assert f("no") == (0.4, ["bare-no"]) and f("fine\nNo.\nthanks") == (0.4, ["bare-no"]) and f("nope") == (0.0, [])
    assert f("no", 201) == (0.6, ["bare-no", "brief-correction"]) and f("ok", 500) == (0.0, []) and f("no", 200)[1] == ["bare-no"]
    assert f("WHY did you STOPPP?? stop touching it!! undo")[0] == 1.0 and f("hi said\r\nagain") == (0.7, ["i-said", "again"])
    assert one(spark, "a" * 301, tx.truncate) == "a" * 300 + "..." and one(spark, " \n a\nb  ", tx.truncate_line) == "a b"
    assert one(spark, "\x1b[1;31mred\x1b[0m", tx.strip_ansi) == "red" and one(spark, "a\n\nb", tx.quoted) == "> a\n> \n> b"
    assert one(spark, " ", tx.blank) is True and one(spark, None, lambda c: sentiment.frustration(c)) is None
    assert one(spark, "\n  \n x\ny", tx.first_filled_line) == " x" and one(spark, "a b", tx.plain_spaces) == "a b"


def test_classes(spark):
    e = lambda t, code=None: one(spark, t, lambda c: classify.error_name(c, F.lit(code).cast("int")))
    assert [e(t) for t in ("File  does\nnot exist", "x FAILED y", "Exit code 7 z", "3 matches for", "hm")] == ["file-not-found", "test-failure", "bash-exit-7", "grep-no-match", "error"] and e("hm", 4) == "bash-exit-4" and e("hm", 0) == "error"
    i = lambda t: tuple(one(spark, t, classify.user_intent))
    assert i("<command-args>a\n b</command-args>") == ("COMMAND", "a b") and i("really?!")[0] == "FRUSTRATION" and i("what now? ")[0] == "QUESTION" and i("do")[0] == "INSTRUCTION"
    a = lambda v: one(spark, json.dumps(v, separators=(",", ":")), lambda c: classify.primary_argument(c, {"/w/": ""}))
    assert a({"cmd": "x", "path": "y"}) == "x" and a({"file_path": "/w/a"}) == "a" and a({"path": "/w/b", "pattern": "p"}) == "b" and a({"pattern": "p"}) == "p" and a({"n": 1, "z": "last"}) == "last" and a({"n": 1}) == ""
    assert one(spark, '{"command":["a",1,"b"]}', classify.command_of) == "a b" and one(spark, "[]", classify.command_of) is None
    assert one(spark, "<command-name>hi</command-name>", classify.is_noise) is True and one(spark, "# AGENTS.md x", classify.without_injected) == ""


def test_ndjson_lines(logs):
    lines = {r["id"]: json.loads(r["line"]) for r in render.ndjson(logs).collect()}
    assert lines["a1"]["sid"] in ("s1", "p1") and lines["m"] == {"sid": "p1", "type": "custom_message", "id": "m", "parentId": None, "timestamp": "2026-02-01T00:00:01Z", "content": "acme/big", "customType": "model_change"}
    assert "parentId" not in lines["p1"] and lines["k1:instructions"]["content"] == ["/A.md"]
    codex = next(json.loads(r["line"]) for r in render.ndjson(logs.where("sid = 'c1' and id = 'e1'")).collect())
    assert codex["thinking"] == {"summary": "think more", "text": None} and codex["toolCalls"][0]["arguments"] == {"command": ["rg", "--files", "x"]} and codex["usage"] == {"input": 40, "output": 7, "cacheRead": 60, "total": 107}
    extra = render.ndjson(logs.where("id = 'm'").withColumn("extra", F.lit('{"sid":"other","n":1}'))).first()["line"]
    assert json.loads(extra)["sid"] == "other" and json.loads(extra)["n"] == 1


def test_markdown_blocks(logs):
    got = {(r["sid"], r["id"]): r["line"] for r in render.markdown(logs).collect()}
    assert got["s1", "s1"] == "# session s1\n\n/work/x · m-1 · 2026-01-02T10:00:00Z\n\n"
    assert got["s1", "a1"] == "## assistant (m-1)\n\n> hm\n\nlooking\n\n→ **terminal** `ls`\n\n→ **Skill** `/a/SKILL.md`\n\n"
    assert got["s1", "a1:skill:t2"] == "### skill · deploy\n\n`/a/SKILL.md`\n\n```yaml\nenv: x\n```\n\n"
    assert got["p1", "r1"] == "### tool_result [error]\n\n```\nFAILED widget\nline 2\nline 3\n```\n\n" and got["p1", "k1"] == "--- compaction: so far ---\n\n"
    assert got["p1", "k1:instructions"] == "### custom_message · instruction_files\n\n```yaml\ncontent:\n  - /A.md\n```\n\n" and got["s1", "e"] == "### error\n\nAPI error 529\n\n"


def test_yaml():
    value = {"a": 1, "b": [], "c": {"d": "x: y", "e": None}, "f": ["p", {"q": 1, "r": "two\nlines"}, [1]], "g": "12", "h": "yes", "i": "", "j": " s", "k": "\nm\n\nn\n", "l": 1.0, "m": True}
    assert yaml.mapping(value).split("\n") == [
        "a: 1", "b: []", "c:", '  d: "x: y"', "  e: null", "f:", "  - p", "  - q: 1", "    r: |-", "      two", "      lines", "  - [1]", 'g: "12"', 'h: "yes"', 'i: ""', 'j: " s"', "k: |-", "  m", "", "  n", "l: 1", "m: true",
    ]


def test_failures_and_summaries(logs):
    target = scanners.Target("widget", ("widget ", "widget\n"), ("bun test",), ("bun test",), "widget-failures")
    found = scanners.failures(logs, target).collect()
    assert [(r["sid"], r["id"], r["kind"], r["command"], r["prior_errors"], r["finding_summary"]) for r in found] == [("p1", "r1", "test_failure", "bun test widget", 0, "FAILED widget")]
    starts, body = logs.where("type = 'session_start'"), logs.where("type != 'session_start'")
    lines = [json.loads(r["line"]) for r in render.ndjson(scanners.failure_scanner(target)(body, starts)).where("sid = 'p1'").orderBy("seq").collect()]
    assert lines[0]["finding"]["kind"] == "test_failure" and lines[1]["customType"] == "scan_summary" and lines[1]["byKind"] == {"tool_error": 0, "bash_error": 0, "test_failure": 1}


def test_scored_messages(spark, logs):
    fixed = lambda m, p: F.create_map(F.lit("correction"), F.when(m == "no", 0.9).otherwise(0.1), F.lit("frustration"), F.when(p == "ok", 0.8).otherwise(0.0))
    got = scanners.scored(logs, fixed).collect()
    assert [(r["id"], r["flags"], r["previous_reply"]) for r in got] == [("u2", ["correction", "frustration"], "ok")]
    with pytest.raises(Exception, match="invalid probability"):
        scanners.scored(logs, lambda m, p: F.create_map(F.lit("x"), F.lit(1.5))).count()
    assert scanners.parse_answer({"model": "m", "answers": {s: {"type": "noul", "noul": 0.5} for s in scanners.SIGNALS}})[1]["correction"] == 0.5
    for bad in ({}, {"model": "m", "answers": {}}, {"model": "m", "answers": {s: {"type": "noul", "noul": 2} for s in scanners.SIGNALS}}):
        with pytest.raises(ValueError):
            scanners.parse_answer(bad)


def test_a_scanner_for_each_session(logs):
    def count(events, start):
        yield {"type": "custom_message", "customType": "count", "n": len(events), "of": start["id"]}

    got = scanners.per_session(count)(logs.where("type != 'session_start'"), logs.where("type = 'session_start'"))
    assert {r["sid"]: json.loads(r["extra"])["n"] for r in got.collect()} == {"s1": 8, "p1": 11, "c1": 7, "2026-06-12-115439-look": 11}


def test_reports_on_logs(logs):
    seg = {(r["sid"], r["segment"]): r for r in agg.segment_counts(logs).collect()}
    assert seg["p1", 0]["tokens_in"] == 10 and seg["p1", 1]["user"] == 1 and seg["s1", 1]["assistant_text"] == 0 and len([k for k in seg if k[0] == "c1"]) == 2
    first = {(r["sid"], r["segment"]): r["output_tokens"] for r in agg.first_turns(logs).collect()}
    assert first["p1", 0] == 20 and first["p1", 1] == 2
    tally = {r["error_name"]: r["n"] for r in agg.error_tally(logs).collect()}
    assert tally == {"test-failure": 1, "bash-exit-2": 2, "error": 2, None: 5} or tally[None] == sum(v for k, v in tally.items() if k)


def test_distribution_ranks(spark):
    rows = spark.createDataFrame([(i, "feat" if i < 3 else "fix") for i in [1, 2, 3, 4]], "output_tokens long, kind string")
    got = {r["name"]: r for r in agg.distribution(rows, ("output_tokens",), "kind").collect()}
    assert (got["All"]["p50"], got["All"]["p90"], got["All"]["max"], got["All"]["mean"], got["feat"]["p50"]) == (3, 4, 4, 2.5, 2)


def test_views(spark, logs):
    api.views(logs, "t_")
    assert spark.sql("select count(*) from t_turns where sid = 'p1'").first()[0] == 2
    assert spark.sql("select call.normalized_name from t_tool_results where sid = 'p1'").first()[0] == "terminal"


def test_plans_share_one_exchange_and_prune(spark):
    plan = queries.QUERIES["turn_context"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "text" not in plan.split("ReadSchema")[1].split("\n")[0].replace("context", "")


def test_filters_by_blocks_are_the_same(spark):
    events = tables.user_events(spark, SF)
    for c in (sel.Criteria(last_turns=1), sel.Criteria(tools=("terminal",)), sel.Criteria(error=True)):
        both = [{(r["sid"], r["seq"]) for r in sel.filter_events(events, c, block_rows=n).select("sid", "seq").collect()} for n in (None, 3)]
        assert both[0] == both[1] and both[0]
    assert not sel.has_trim() and sel.has_trim(tool_lines=0) and sel.has_trim(no_thinking=True)


def test_a_turns_calls_are_looked_up_without_joins(spark):
    """One exchange by session serves the context, the look-up and what comes after."""
    events = tables.user_events(spark, SF).select("sid", "seq", "type", "tool_calls", "tool_call_id", "model")
    plan = joins.with_call_in_turn(ctx.with_context(events))._jdf.queryExecution().executedPlan().toString()
    alone = ctx.with_context(events)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == alone.count("Exchange hashpartitioning")


def test_calls_without_ids_and_of_other_turns(spark):
    call = lambda i, name: (i, name, name, "{}")
    rows = [
        ("s", 0, "user_message", None, None, "m"), ("s", 1, "assistant_message", [call("c", "first"), call("c", "second"), call(None, "nameless")], None, "m"),
        ("s", 2, "tool_result", None, "c", None), ("s", 3, "tool_result", None, None, None), ("s", 4, "user_message", None, None, None), ("s", 5, "tool_result", None, "c", None),
        ("s", 6, "assistant_message", [call("d", "late")], None, "m"), ("s", 7, "tool_result", None, "d", None),
    ]
    kind = "sid string, seq long, type string, tool_calls array<struct<id:string,name:string,normalized_name:string,arguments:string>>, tool_call_id string, model string"
    got = joins.with_call_in_turn(ctx.with_context(spark.createDataFrame(rows, kind))).orderBy("seq").collect()
    assert [(r["seq"], r["call"] and r["call"]["name"]) for r in got] == [(0, None), (1, None), (2, "first"), (3, None), (4, None), (5, None), (6, None), (7, "late")]
