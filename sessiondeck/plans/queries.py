"""The operators as queries over the tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import render, scanners
from ..functions import classify, sentiment, text as tx
from ..operators import aggregates as agg, context as ctx, joins, select as sel
from ..sources import logs, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _quoted(x: str | None) -> str:
    if x is None:
        return "NULL"
    parts = ["'" + p.replace("'", "''") + "'" for p in _split_control(x)]
    return "(" + " || ".join(parts) + ")" if len(parts) == 1 else "(" + " || ".join(p if not p.startswith("'\x00") else f"chr({int(p[2:-1])})" for p in parts) + ")"


def _split_control(x: str) -> list[str]:
    out, held = [], ""
    for c in x:
        if ord(c) < 32:
            out += [held, f"\x00{ord(c)}"]
            held = ""
        else:
            held += c
    return [*out, held]


def _case(at: str, values: tuple) -> str:
    return f"CASE {at} " + " ".join(f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(values)) + " END"


def _call(n: str, i: str) -> str:
    return f"""{{'id': 'c' || CAST({n} % 4 AS VARCHAR), 'name': {_case(f"({i}) % 3", tables.TOOLS)}, 'normalized_name': {_case(f"({i}) % 3", tables.NORMALIZED)}, 'command': {_case(f"({i}) % 8", tables.COMMANDS)}}}"""


#: The events as sources.tables makes them.
EV = f"""
raw AS (
  SELECT CAST(user_id AS VARCHAR) AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(round(value * 100) AS BIGINT) AS cents, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp
  FROM events
), typed AS (
  SELECT *, CASE WHEN event_type = 'view' THEN 'user_message' WHEN event_type = 'click' THEN 'assistant_message' WHEN event_type IN ('purchase', 'error') THEN 'tool_result'
                 WHEN event_type = 'signup' AND k % 10 = 0 THEN 'skill_invocation' ELSE 'compaction' END AS type
  FROM raw
), ev AS (
  SELECT sid, seq, type, k, cents, timestamp, 'e' || CAST(seq AS VARCHAR) AS id,
         CASE WHEN seq > 0 THEN 'e' || CAST(CASE WHEN seq % 5 = 3 THEN seq - 2 ELSE seq - 1 END AS VARCHAR) END AS parent_id,
         CASE WHEN type = 'user_message' THEN {_case(f"k % {len(tables.MESSAGES)}", tables.MESSAGES)} WHEN type = 'assistant_message' THEN CASE WHEN k % 3 = 0 THEN ' ' ELSE 'reply ' || CAST(k AS VARCHAR) END END AS text,
         CASE WHEN type = 'assistant_message' THEN CASE WHEN k % 3 = 0 THEN '' ELSE 'm' || CAST(k % 3 AS VARCHAR) END END AS model,
         CASE WHEN type = 'assistant_message' THEN CASE WHEN k % 10 = 0 THEN [{_call("k", "k")}, {_call("(k + 1)", "k + 1")}] WHEN k % 2 = 0 THEN [{_call("k", "k")}] ELSE [] END END AS calls,
         CASE WHEN type = 'skill_invocation' THEN 'skill' || CAST(k AS VARCHAR) END AS name,
         CASE WHEN type = 'tool_result' THEN 'c' || CAST(k % 4 AS VARCHAR) END AS tool_call_id,
         CASE WHEN type = 'tool_result' THEN {_case(f"k % {len(tables.CONTENTS)}", tables.CONTENTS)} END AS content,
         CASE WHEN type = 'tool_result' THEN event_type = 'error' END AS is_error,
         CASE WHEN event_type = 'error' AND k % 2 = 0 THEN CAST(k % 5 AS INTEGER) END AS exit_code
  FROM typed
)"""
#: The events with their turns and segments.
CX = f"""{EV}, cx AS (
  SELECT *, CAST(sum(CASE WHEN type = 'user_message' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS turn_no, coalesce(last_value(CASE WHEN type = 'assistant_message' AND model <> '' THEN model END IGNORE NULLS) OVER w, '') AS active_model,
         CAST(sum(CASE WHEN type = 'compaction' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment
  FROM ev WINDOW w AS (PARTITION BY sid ORDER BY seq ROWS UNBOUNDED PRECEDING)
), calls AS (
  SELECT sid, seq, type, turn_no, segment, timestamp, i - 1 AS pos, calls[i].id AS call_id, calls[i].name AS name, calls[i].normalized_name AS normalized_name, calls[i].command AS command
  FROM (SELECT *, unnest(range(1, len(calls) + 1)) AS i FROM cx WHERE type = 'assistant_message') x
)"""
#: Conversations as events.
CV = """
cv AS (
  SELECT CAST(conv_id AS VARCHAR) AS sid, turn AS seq, CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'custom_message' END AS type, text,
         CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS id,
         CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_no
  FROM conversations
)"""
FIRST = f"""{CX}, nth AS (
  SELECT *, sum(CASE WHEN type = 'user_message' THEN 1 ELSE 0 END) OVER (PARTITION BY sid, segment ORDER BY seq ROWS UNBOUNDED PRECEDING) AS n FROM cx
), ft AS (
  SELECT sid, segment, count(*) FILTER (WHERE type = 'assistant_message') AS asst_turns, CAST(coalesce(sum(len(calls)) FILTER (WHERE type = 'assistant_message'), 0) AS BIGINT) AS tool_calls,
         CAST(coalesce(sum(cents) FILTER (WHERE type = 'assistant_message'), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(k) FILTER (WHERE type = 'assistant_message'), 0) AS BIGINT) AS input_tokens,
         CAST(coalesce(sum(k % 7) FILTER (WHERE type = 'assistant_message'), 0) AS BIGINT) AS cache_read
  FROM nth WHERE n = 1 GROUP BY sid, segment
), turns AS (SELECT * FROM ft WHERE asst_turns > 0)"""


def query(name: str, sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return tables.user_events(spark, d)


def _cx(spark: SparkSession, d: str) -> DataFrame:
    return ctx.with_context(_ev(spark, d))


def _cv(spark: SparkSession, d: str) -> DataFrame:
    return tables.conversation_events(spark, d)


def _keys(df: DataFrame) -> DataFrame:
    return df.select("sid", "seq", "type")


@query("turn_context", f"WITH {CX} SELECT sid, seq, type, turn_no, active_model, segment FROM cx")
def turn_context(spark, d):
    return _cx(spark, d).select("sid", "seq", "type", "turn_no", "active_model", "segment")


@query("last_turns", f"WITH {CV} SELECT sid, seq, type, turn_no, text FROM (SELECT *, max(turn_no) OVER (PARTITION BY sid) AS m FROM cv) x WHERE turn_no > 0 AND turn_no > m - 2")
def last_turns(spark, d):
    return sel.last_turns(ctx.with_context(_cv(spark, d)), 2).select("sid", "seq", "type", "turn_no", F.coalesce("text", "content").alias("text"))


for _name, _c, _where in (
    ("filter_types", sel.Criteria(types=("user_message", "compaction")), "type IN ('user_message', 'compaction')"),
    ("filter_roles", sel.Criteria(roles=("assistant", "tool_result")), "type IN ('assistant_message', 'tool_result')"),
    ("filter_error_only", sel.Criteria(error=True), "type = 'tool_result' AND is_error"),
    ("filter_tool_results_errors", sel.Criteria(tool_results="errors"), "NOT (type = 'tool_result' AND NOT is_error)"),
):
    query(_name, f"WITH {EV} SELECT sid, seq, type FROM ev WHERE {_where}")(lambda spark, d, c=_c: _keys(sel.filter_events(_ev(spark, d), c)))

_IN_TURN = """called AS (
  SELECT r.sid, r.seq, arg_min({'name': c.name, 'normalized_name': c.normalized_name, 'command': c.command}, c.seq * 100 + c.pos) AS call
  FROM cx r JOIN calls c ON r.sid = c.sid AND r.turn_no = c.turn_no AND r.tool_call_id = c.call_id AND c.seq < r.seq
  WHERE r.type = 'tool_result' AND r.turn_no > 0 GROUP BY r.sid, r.seq
)"""


@query("filter_tools", f"""WITH {CX}, {_IN_TURN} SELECT x.sid, x.seq, x.type FROM cx x LEFT JOIN called d ON x.sid = d.sid AND x.seq = d.seq
WHERE (x.type = 'assistant_message' AND len(list_filter(x.calls, lambda c: coalesce(c.normalized_name, c.name) IN ('terminal', 'Edit'))) > 0) OR (x.type = 'tool_result' AND coalesce(d.call.normalized_name, 'native') IN ('terminal', 'Edit'))""")
def filter_tools(spark, d):
    return _keys(sel.filter_events(_ev(spark, d), sel.Criteria(tools=("terminal", "Edit"))))


@query("filter_combined", f"""WITH {CX}, chosen AS (SELECT DISTINCT sid FROM ev WHERE type = 'skill_invocation' AND name IN ('skill10', 'skill30')), kept AS (SELECT *, max(turn_no) OVER (PARTITION BY sid) AS m FROM cx WHERE sid IN (SELECT sid FROM chosen))
SELECT sid, seq, type FROM kept WHERE turn_no > 0 AND turn_no > m - 3 AND type = 'tool_result' AND is_error""")
def filter_combined(spark, d):
    return _keys(sel.filter_events(_ev(spark, d), sel.Criteria(skills=("skill10", "skill30"), last_turns=3, roles=("tool_result",), tool_results="errors")))


@query("skill_semi_join", f"WITH {EV} SELECT sid, seq, type FROM ev WHERE sid IN (SELECT sid FROM ev WHERE type = 'skill_invocation' AND name IN ('skill20', 'skill50'))")
def skill_semi_join(spark, d):
    return _keys(sel.by_skill(_ev(spark, d), ["skill20", "skill50"]))


@query("call_in_turn", f"WITH {CX}, {_IN_TURN} SELECT x.sid, x.seq, d.call.name AS name, d.call.normalized_name AS normalized_name FROM cx x LEFT JOIN called d ON x.sid = d.sid AND x.seq = d.seq WHERE x.type = 'tool_result'")
def call_in_turn(spark, d):
    return joins.with_call_in_turn(_cx(spark, d)).where("type = 'tool_result'").select("sid", "seq", F.col("call.name").alias("name"), F.col("call.normalized_name").alias("normalized_name"))


@query("call_names_as_of", f"""WITH {CX}, pick AS (SELECT r.sid, r.seq, r.tool_call_id AS call_id, c.name, row_number() OVER (PARTITION BY r.sid, r.seq ORDER BY c.seq DESC, c.pos DESC) AS n FROM cx r LEFT JOIN calls c ON r.sid = c.sid AND r.tool_call_id = c.call_id AND c.seq < r.seq WHERE r.type = 'tool_result')
SELECT sid, seq, call_id, coalesce(name, '') AS called FROM pick WHERE n = 1""")
def call_names_as_of(spark, d):
    return joins.names_as_of(_ev(spark, d))


@query("usage_zip", f"""WITH {EV}, a AS (SELECT sid, seq, row_number() OVER (PARTITION BY sid ORDER BY seq) AS i FROM ev WHERE type = 'assistant_message'), u AS (SELECT sid, cents, row_number() OVER (PARTITION BY sid ORDER BY seq) AS i FROM ev WHERE type = 'tool_result')
SELECT a.sid, a.seq, u.cents FROM a LEFT JOIN u ON a.sid = u.sid AND a.i = u.i""")
def usage_zip(spark, d):
    ev = _ev(spark, d)
    return joins.zip_by_position(ev.where("type = 'assistant_message'").select("sid", "seq"), ev.where("type = 'tool_result'").select("sid", "seq", "cents")).select("sid", "seq", F.col("right.cents").alias("cents"))


_RESULTS = "res AS (SELECT sid, tool_call_id AS call_id, arg_max({'is_error': is_error, 'content': content, 'exit_code': exit_code, 'seq': seq}, seq) AS r FROM cx WHERE type = 'tool_result' GROUP BY sid, tool_call_id)"


@query("calls_with_results", f"WITH {CX}, {_RESULTS} SELECT c.sid, c.seq, c.pos, c.call_id, c.name, res.r.seq AS result_seq, res.r.is_error AS is_error FROM calls c LEFT JOIN res ON c.sid = res.sid AND c.call_id = res.call_id")
def calls_with_results(spark, d):
    return joins.calls_with_results(_ev(spark, d)).select("sid", "seq", F.col("pos").cast("long").alias("pos"), "call_id", "name", F.col("result.seq").alias("result_seq"), F.col("result.is_error").alias("is_error"))


_PHASES = [("start", None, "2024-01-05"), ("middle", "2024-01-05", "2024-01-15"), ("all", None, None), ("end", "2024-01-20", "")]


@query("phase_range_join", f"""WITH {EV}, phases(phase, low, high) AS (VALUES ('start', NULL, '2024-01-05'), ('middle', '2024-01-05', '2024-01-15'), ('all', NULL, NULL), ('end', '2024-01-20', ''))
SELECT p.phase, e.type, count(*) AS n FROM ev e JOIN phases p ON (coalesce(p.low, '') = '' OR e.timestamp >= p.low) AND (coalesce(p.high, '') = '' OR e.timestamp < p.high) WHERE e.type IN ('user_message', 'assistant_message') GROUP BY 1, 2""")
def phase_range_join(spark, d):
    phases = spark.createDataFrame(_PHASES, "phase string, low string, high string")
    return joins.by_phase(_ev(spark, d).where("type in ('user_message', 'assistant_message')"), phases).groupBy("phase", "type").agg(F.count("*").alias("n"))


@query("config_lookup", f"WITH {EV}, book(sid, role, label) AS (VALUES ('1', 'fix', 'One'), ('2', 'review', 'Two')) SELECT s.sid, coalesce(b.role, '?') AS role, coalesce(b.label, s.sid) AS label FROM (SELECT DISTINCT sid FROM ev) s LEFT JOIN book b ON s.sid = b.sid")
def config_lookup(spark, d):
    book = spark.createDataFrame([("1", "fix", "One"), ("2", "review", "Two")], "sid string, role string, label string")
    return joins.looked_up(_ev(spark, d).select("sid").distinct(), book, "sid", {"role": F.lit("?"), "label": F.col("sid")})


@query("previous_reply", f"""WITH {CX}, reply AS (SELECT sid, turn_no, arg_max(text, seq) AS t FROM cx WHERE turn_no > 0 AND type = 'assistant_message' AND trim(text) <> '' GROUP BY sid, turn_no)
SELECT x.sid, x.seq, r.t AS previous_reply FROM cx x LEFT JOIN reply r ON x.sid = r.sid AND r.turn_no = x.turn_no - 1 WHERE x.type = 'user_message'""")
def previous_reply(spark, d):
    return ctx.with_previous_reply(_cx(spark, d)).select("sid", "seq", "previous_reply")


@query("conversation_previous_reply", f"""WITH {CV}, reply AS (SELECT sid, turn_no, arg_max(text, seq) AS t FROM cv WHERE turn_no > 0 AND type = 'assistant_message' AND trim(text) <> '' GROUP BY sid, turn_no)
SELECT x.sid, x.seq, r.t AS previous_reply FROM cv x LEFT JOIN reply r ON x.sid = r.sid AND r.turn_no = x.turn_no - 1 WHERE x.type = 'user_message'""")
def conversation_previous_reply(spark, d):
    return ctx.with_previous_reply(ctx.with_context(_cv(spark, d))).select("sid", "seq", "previous_reply")


@query("head_ancestry", f"""WITH RECURSIVE {EV}, path AS (SELECT sid, max(seq) AS seq FROM ev GROUP BY sid UNION ALL SELECT sid, CASE WHEN seq % 5 = 3 THEN seq - 2 ELSE seq - 1 END FROM path WHERE seq > 0) SELECT sid, seq, 'e' || CAST(seq AS VARCHAR) AS id FROM path""")
def head_ancestry(spark, d):
    entries = _ev(spark, d).select("sid", "id", "parent_id", "seq")
    heads = entries.groupBy("sid").agg(F.max_by("id", "seq").alias("head"))
    return sel.head_path(entries, heads).select("sid", "seq", "id")


@query("prior_errors_in_turn", f"WITH {CX} SELECT sid, seq, CAST(CASE WHEN turn_no > 0 THEN coalesce(sum(CASE WHEN type = 'tool_result' AND is_error THEN 1 ELSE 0 END) OVER (PARTITION BY sid, turn_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END AS BIGINT) AS prior FROM cx")
def prior_errors_in_turn(spark, d):
    return ctx.with_prior(_cx(spark, d), agg.failed(), "prior").select("sid", "seq", "prior")


@query("turn_events", f"""WITH {CX} SELECT sid, seq, CASE WHEN turn_no > 0 THEN coalesce(string_agg(CASE WHEN type <> 'user_message' THEN id END, ',') OVER (PARTITION BY sid, turn_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS earlier FROM cx""")
def turn_events(spark, d):
    return ctx.with_turn_events(_cx(spark, d), "id").select("sid", "seq", F.array_join(F.transform("turn_events", lambda x: x["id"]), ",").alias("earlier"))


@query("turns", f"""WITH {CX} SELECT sid, turn_no, min(seq) AS first_seq, max(seq) AS last_seq, arg_min(text, seq) FILTER (WHERE type = 'user_message') AS user_text, count(*) FILTER (WHERE type = 'assistant_message') AS assistant_messages,
count(*) FILTER (WHERE type = 'tool_result') AS tool_results, arg_max(text, seq) FILTER (WHERE type = 'assistant_message' AND trim(text) <> '') AS last_reply FROM cx WHERE turn_no > 0 GROUP BY sid, turn_no""")
def turns(spark, d):
    return ctx.turns(_cx(spark, d)).drop("run_no")


@query("carry_forward", f"WITH {EV} SELECT sid, seq, last_value(CASE WHEN k % 4 = 0 THEN timestamp END IGNORE NULLS) OVER (PARTITION BY sid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS at FROM ev")
def carry_forward(spark, d):
    return _ev(spark, d).select("sid", "seq", ctx.carried(F.when(F.col("k") % 4 == 0, F.col("timestamp"))).alias("at"))


@query("message_islands", f"""WITH {EV}, g AS (SELECT *, sum(CASE WHEN type <> 'assistant_message' THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM ev)
SELECT sid, min(seq) AS first_seq, string_agg(text, chr(10) ORDER BY seq) AS text, CAST(sum(len(calls)) AS BIGINT) AS calls FROM g WHERE type = 'assistant_message' GROUP BY sid, island""")
def message_islands(spark, d):
    got = ctx.islands(_ev(spark, d), F.col("type") != "assistant_message", F.col("type") == "assistant_message")
    return got.groupBy("sid", "island").agg(F.min("seq").alias("first_seq"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"), F.sum(F.size("tool_calls")).alias("calls")).drop("island")


@query("parent_chain", f"WITH {EV} SELECT sid, seq, lag(id) OVER (PARTITION BY sid ORDER BY seq) AS parent_id FROM ev")
def parent_chain(spark, d):
    return ctx.parent_chain(_ev(spark, d)).select("sid", "seq", "parent_id")


@query("trim_lines", f"WITH {EV} SELECT sid, seq, array_to_string(list_slice(string_split(content, chr(10)), 1, 2), chr(10)) AS content FROM ev WHERE type = 'tool_result'")
def trim_lines(spark, d):
    return sel.trim(_ev(spark, d), tool_lines=2).where("type = 'tool_result'").select("sid", "seq", "content")


@query("run_stats", f"WITH {EV} SELECT count(DISTINCT CASE WHEN type = 'session_start' THEN sid END) AS sessions_found, count(DISTINCT sid) AS sessions_written, count(*) AS events_written FROM ev")
def run_stats(spark, d):
    return agg.run_stats(_ev(spark, d))


@query("session_stats", f"WITH {EV} SELECT sid, count(*) FILTER (WHERE type = 'assistant_message') AS asst, count(*) FILTER (WHERE type = 'tool_result') AS tools, count(*) FILTER (WHERE type = 'tool_result' AND is_error) AS errs FROM ev GROUP BY sid")
def session_stats(spark, d):
    return agg.session_stats(_ev(spark, d))


@query("session_span", f"WITH {EV}, s AS (SELECT sid, min(timestamp) AS a, max(timestamp) AS b FROM ev GROUP BY sid) SELECT sid, substr(a, 12, 5) || ' → ' || substr(b, 12, 5) || ' UTC (' || substr(a, 1, 10) || ')' AS span FROM s")
def session_span(spark, d):
    return agg.session_span(_ev(spark, d)).select("sid", agg.span_text(F.col("first_at"), F.col("last_at")).alias("span"))


@query("tool_histogram", f"WITH {CX} SELECT sid, name, count(*) AS n FROM calls GROUP BY sid, name")
def tool_histogram(spark, d):
    return agg.tool_histogram(_ev(spark, d), "sid").drop("first_seen")


def _error_case(c: str, code: str) -> str:
    rules = " ".join(f"WHEN regexp_matches({c}, {_quoted(rx)}) THEN {_quoted(name)}" for rx, name in classify.ERRORS)
    return f"CASE {rules} WHEN regexp_extract({c}, '^Exit code ([0-9]+)', 1) <> '' THEN 'bash-exit-' || regexp_extract({c}, '^Exit code ([0-9]+)', 1) WHEN coalesce({code}, 0) <> 0 THEN 'bash-exit-' || CAST({code} AS VARCHAR) ELSE 'error' END"


def _bare(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '\\s+', ' ', 'g'), chr(27) || '\\[[0-9;]*m', '', 'g')"


@query("error_tally_rollup", f"WITH {CX}, {_RESULTS}, bad AS (SELECT {_error_case(_bare('res.r.content'), 'res.r.exit_code')} AS error_name FROM calls c JOIN res ON c.sid = res.sid AND c.call_id = res.call_id WHERE res.r.is_error) SELECT error_name, count(*) AS n FROM bad GROUP BY ROLLUP (error_name)")
def error_tally_rollup(spark, d):
    return agg.error_tally(_ev(spark, d))


@query("duplicate_ids", f"WITH {EV} SELECT sid, tool_call_id, count(*) AS n FROM ev WHERE type = 'tool_result' GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return agg.duplicates(_ev(spark, d).where("type = 'tool_result'"), "sid", "tool_call_id")


@query("segment_counts", f"""WITH {CX}, every AS (SELECT sid, unnest(range(0, cuts + 1)) AS segment FROM (SELECT sid, count(*) FILTER (WHERE type = 'compaction') AS cuts FROM cx GROUP BY sid) s), sums AS (
SELECT sid, segment, count(*) FILTER (WHERE type = 'user_message') AS user, count(*) FILTER (WHERE type = 'assistant_message' AND trim(text) <> '') AS assistant_text, CAST(coalesce(sum(len(calls)) FILTER (WHERE type = 'assistant_message'), 0) AS BIGINT) AS tool_call,
count(*) FILTER (WHERE type = 'tool_result') AS tool_result, CAST(coalesce(sum(k) FILTER (WHERE type = 'assistant_message'), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(cents) FILTER (WHERE type = 'assistant_message'), 0) AS BIGINT) AS tokens_out FROM cx WHERE type <> 'compaction' GROUP BY sid, segment)
SELECT e.sid, e.segment, coalesce(user, 0) AS user, coalesce(assistant_text, 0) AS assistant_text, coalesce(tool_call, 0) AS tool_call, coalesce(tool_result, 0) AS tool_result, coalesce(tokens_in, 0) AS tokens_in, coalesce(tokens_out, 0) AS tokens_out FROM every e LEFT JOIN sums s ON e.sid = s.sid AND e.segment = s.segment""")
def segment_counts(spark, d):
    return agg.segment_counts(_ev(spark, d))


@query("first_turns", f"WITH {FIRST} SELECT * FROM turns")
def first_turns(spark, d):
    return agg.first_turns(_ev(spark, d))


def _kind(df: DataFrame) -> DataFrame:
    return df.withColumn("kind", F.when(F.col("sid").cast("long") % 2 == 0, "feat").otherwise("fix"))


_AT = "list_sort(list(v))[least(count(*), CAST(floor(count(*) * {p}::DOUBLE) AS BIGINT) + 1)]"


@query("first_turn_distribution", f"""WITH {FIRST}, named AS (SELECT *, CASE WHEN CAST(sid AS BIGINT) % 2 = 0 THEN 'feat' ELSE 'fix' END AS kind FROM turns), long AS (
SELECT unnest(['All', kind]) AS name, asst_turns, tool_calls, output_tokens, input_tokens, cache_read FROM named), m AS (SELECT name, unnest(['asst_turns', 'tool_calls', 'output_tokens', 'input_tokens', 'cache_read']) AS metric, unnest([asst_turns, tool_calls, output_tokens, input_tokens, cache_read]) AS v FROM long)
SELECT name, metric, count(*) AS n, round(avg(v), 6) AS mean, max(v) AS max, {_AT.format(p=0.5)} AS p50, {_AT.format(p=0.9)} AS p90, {_AT.format(p=0.99)} AS p99 FROM m GROUP BY name, metric""")
def first_turn_distribution(spark, d):
    return agg.distribution(_kind(agg.first_turns(_ev(spark, d))), group="kind").withColumn("mean", F.round("mean", 6))


@query("first_turn_totals", f"WITH {FIRST} SELECT count(*) AS n, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cache_read) AS BIGINT) AS cache_read FROM turns")
def first_turn_totals(spark, d):
    return agg.totals(agg.first_turns(_ev(spark, d)))


@query("first_turn_top10", f"WITH {FIRST} SELECT * FROM turns ORDER BY output_tokens DESC, sid, segment LIMIT 10")
def first_turn_top10(spark, d):
    return agg.longest(agg.first_turns(_ev(spark, d)), ("sid", "segment"))


@query("truncate_line", f"WITH {EV}, t AS (SELECT sid, seq, trim(replace(content, chr(10), ' ')) AS c, content FROM ev WHERE type = 'tool_result') SELECT sid, seq, CASE WHEN length(c) <= 12 THEN c ELSE substr(c, 1, 12) || '...' END AS line, CASE WHEN length(content) <= 20 THEN content ELSE substr(content, 1, 20) || '...' END AS cut FROM t")
def truncate_line(spark, d):
    return _ev(spark, d).where("type = 'tool_result'").select("sid", "seq", tx.truncate_line("content", 12).alias("line"), tx.truncate("content", 20).alias("cut"))


@query("strip_ansi_one_line", f"WITH {EV}, t AS (SELECT sid, seq, content, regexp_replace(content, '\\s+', ' ', 'g') AS o FROM ev WHERE type = 'tool_result') SELECT sid, seq, regexp_replace(content, chr(27) || '\\[[0-9;]*m', '', 'g') AS plain, CASE WHEN length(o) > 15 THEN substr(o, 1, 15) || '…' ELSE o END AS line FROM t")
def strip_ansi_one_line(spark, d):
    return _ev(spark, d).where("type = 'tool_result'").select("sid", "seq", tx.strip_ansi("content").alias("plain"), tx.one_line("content", 15).alias("line"))


@query("document_lines", "SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE substr(t, 1, 120) || '...' END AS line FROM (SELECT doc_id, trim(regexp_replace(text, chr(10), ' ', 'g')) AS t FROM documents) x")
def document_lines(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.truncate_line("text").alias("line"))


def _signal(name: str, rx: str) -> str:
    p = rx.replace("'", "''")
    return f"regexp_matches(text, '{p}')" if name in sentiment.CASED else f"regexp_matches(text, '(?im){p}')"


_HITS = ", ".join(f"{{'s': '{n}', 'w': {w}, 'h': {_signal(n, rx)}}}" for n, w, rx in sentiment.SIGNALS)


@query("frustration_score", f"""WITH {EV}, t AS (SELECT sid, seq, text, list_filter([{_HITS}], lambda x: x.h) AS hits, k * 4 > 200 AND length(text) < 20 AS brief FROM ev WHERE type = 'user_message')
SELECT sid, seq, round(least(1.0, coalesce(list_sum(list_transform(hits, lambda x: CAST(x.w AS DOUBLE))), 0) + CASE WHEN brief AND len(hits) > 0 THEN 0.2 ELSE 0 END), 6) AS score,
array_to_string(list_transform(hits, lambda x: x.s), ',') || CASE WHEN brief AND len(hits) > 0 THEN ',brief-correction' ELSE '' END AS signals FROM t""")
def frustration_score(spark, d):
    return _ev(spark, d).where("type = 'user_message'").withColumn("f", sentiment.frustration("text", F.col("k") * 4)).select("sid", "seq", F.col("f.score").alias("score"), F.array_join("f.signals", ",").alias("signals"))


_INTENT = " ".join(f"WHEN regexp_matches(text, {_quoted('(?i)' + rx)}) THEN '{name}'" for rx, name in classify.INTENTS)


@query("user_intent", f"""WITH {EV}, t AS (SELECT sid, seq, text, CASE WHEN regexp_matches(text, '(?s)<command-args>(.*?)</command-args>') THEN regexp_extract(text, '(?s)<command-args>(.*?)</command-args>', 1) ELSE text END AS body,
CASE WHEN regexp_matches(text, '(?s)<command-args>(.*?)</command-args>') OR starts_with(text, '<command') THEN 'COMMAND' {_INTENT} WHEN ends_with(trim(text), '?') THEN 'QUESTION' ELSE 'INSTRUCTION' END AS intent FROM ev WHERE type = 'user_message')
SELECT sid, seq, intent, regexp_replace(body, '\\s+', ' ', 'g') AS text FROM t""")
def user_intent(spark, d):
    return _ev(spark, d).where("type = 'user_message'").withColumn("i", classify.user_intent("text")).select("sid", "seq", "i.intent", "i.text")


@query("error_name", f"WITH {EV} SELECT sid, seq, {_error_case(_bare('content'), 'exit_code')} AS error_name FROM ev WHERE type = 'tool_result'")
def error_name(spark, d):
    return _ev(spark, d).where("type = 'tool_result'").select("sid", "seq", classify.error_name("content", "exit_code").alias("error_name"))


_KINDS = " ".join(f"WHEN regexp_matches(command, '^{rx}') THEN '{kind}'" for rx, kind in classify.COMMANDS)


@query("command_kind", f"WITH {CX} SELECT sid, seq, pos, command, CASE {_KINDS} ELSE 'terminal' END AS kind FROM calls")
def command_kind(spark, d):
    made = joins.calls(_ev(spark, d)).withColumn("command", classify.command_of("arguments"))
    return made.select("sid", "seq", F.col("pos").cast("long").alias("pos"), classify.primary_argument("arguments").alias("command"), classify.command_kind("command").alias("kind"))


@query("is_noise", f"""WITH {EV} SELECT sid, seq, trim(text) = '' OR (starts_with(trim(text), '<command-') AND length(trim(regexp_replace(text, '<[^>]+>', '', 'g'))) < 30) AS noise FROM ev WHERE type = 'user_message'""")
def is_noise(spark, d):
    return _ev(spark, d).where("type = 'user_message'").select("sid", "seq", classify.is_noise("text").alias("noise"))


@query("ndjson", f"""WITH {CV} SELECT sid, seq, '{{"sid":' || to_json(sid) || ',"type":' || to_json(type) || ',"id":' || to_json(id) || ',"parentId":null,"timestamp":""' || CASE type WHEN 'user_message' THEN ',"text":' || to_json(text) WHEN 'assistant_message' THEN ',"model":"","text":' || to_json(text) || ',"toolCalls":[],"provider":""'
ELSE ',"content":' || to_json(text) || ',"customType":"system"' END || '}}' AS line FROM cv""")
def ndjson(spark, d):
    return render.ndjson(_cv(spark, d)).select("sid", "seq", "line")


@query("markdown", f"""WITH {CX} SELECT sid, seq, CASE type WHEN 'user_message' THEN '## user' || chr(10) || chr(10) || text WHEN 'tool_result' THEN '### tool_result' || CASE WHEN is_error THEN ' [error]' ELSE '' END || chr(10) || chr(10) || '```' || chr(10) || content || chr(10) || '```'
WHEN 'compaction' THEN '--- compaction ---' WHEN 'skill_invocation' THEN '### skill · ' || name ELSE '## assistant' || CASE WHEN model <> '' THEN ' (' || model || ')' ELSE '' END || chr(10) || chr(10) || text || coalesce((SELECT string_agg(chr(10) || chr(10) || '→ **' || coalesce(c.normalized_name, c.name) || '** `' || c.command || '`', '' ORDER BY c.pos) FROM calls c WHERE c.sid = cx.sid AND c.seq = cx.seq), '') END || chr(10) || chr(10) AS block FROM cx""")
def markdown(spark, d):
    return render.markdown(_ev(spark, d)).select("sid", "seq", F.col("line").alias("block"))


_MENTION = "(starts_with(lower({c}), 'widget') OR contains(lower({c}), 'widget ') OR contains(lower({c}), '/widget') OR contains(lower({c}), 'workspace-not-found'))"
_FOUND = f"""{CX}, {_IN_TURN}, prior AS (SELECT sid, seq, coalesce(sum(CASE WHEN type = 'tool_result' AND is_error THEN 1 ELSE 0 END) OVER (PARTITION BY sid, turn_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n, first_value(text) OVER (PARTITION BY sid, turn_no ORDER BY seq) AS prompt FROM cx WHERE turn_no > 0), found AS (
SELECT x.sid, x.seq, d.call.command AS command, CASE WHEN coalesce(contains(d.call.command, 'bun test'), false) OR contains(x.content, 'bun test') THEN 'test_failure' WHEN coalesce(d.call.normalized_name = 'terminal', false) OR x.exit_code IS NOT NULL THEN 'bash_error' ELSE 'tool_error' END AS kind, CAST(coalesce(p.n, 0) AS BIGINT) AS prior_errors, p.prompt AS user_prompt
FROM cx x LEFT JOIN called d ON x.sid = d.sid AND x.seq = d.seq LEFT JOIN prior p ON x.sid = p.sid AND x.seq = p.seq WHERE x.type = 'tool_result' AND x.is_error AND (coalesce({_MENTION.format(c="d.call.command")}, false) OR {_MENTION.format(c="x.content")}))"""
WIDGET = scanners.Target(prefix="widget", parts=("widget ", "/widget", "workspace-not-found"), test_commands=("bun test",), test_outputs=("bun test",))


@query("failure_findings", f"WITH {_FOUND} SELECT * FROM found")
def failure_findings(spark, d):
    return scanners.failures(_ev(spark, d), WIDGET).select("sid", "seq", "command", "kind", "prior_errors", "user_prompt")


@query("scan_summary", f"""WITH {_FOUND} SELECT s.sid, count(f.sid) AS findings, count(*) FILTER (WHERE f.kind = 'tool_error') AS tool_error, count(*) FILTER (WHERE f.kind = 'bash_error') AS bash_error, count(*) FILTER (WHERE f.kind = 'test_failure') AS test_failure
FROM (SELECT DISTINCT sid FROM ev) s LEFT JOIN found f ON s.sid = f.sid GROUP BY s.sid""")
def scan_summary(spark, d):
    ev = _ev(spark, d)
    return scanners.summary(ev, scanners.failures(ev, WIDGET))


@query("scored_messages", f"""WITH {CX}, reply AS (SELECT sid, turn_no, arg_max(text, seq) AS t FROM cx WHERE turn_no > 0 AND type = 'assistant_message' AND trim(text) <> '' GROUP BY sid, turn_no), s AS (
SELECT x.sid, x.seq, x.text, coalesce(r.t, '') AS p FROM cx x LEFT JOIN reply r ON x.sid = r.sid AND r.turn_no = x.turn_no - 1 WHERE x.type = 'user_message' AND trim(x.text) <> '')
SELECT sid, seq, length(text) > 8000 AS message_cut, length(p) > 8000 AS reply_cut FROM s WHERE least(1.0, length(substr(text, 1, 8000)) / 8.0) >= 0.8""")
def scored_messages(spark, d):
    def long(message, reply):
        return F.create_map(F.lit("length"), F.least(F.lit(1.0), F.length(message) / 8.0))

    return scanners.scored(_ev(spark, d), long).select("sid", "seq", F.col("truncated.current_message").alias("message_cut"), F.col("truncated.previous_message").alias("reply_cut"))


@query("event_windows", """SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    from ..streaming import live

    return live.event_windows(spark.read.parquet(f"{d}/events.parquet")).select("start", "event_type", "n", "cents")


# --- logs: conversations as native logs, parsed again ---------------------------

_CLAUDE = """logged AS (
  SELECT CAST(conv_id AS VARCHAR) AS sid, 0 AS seq, 'session_start' AS type, CAST(conv_id AS VARCHAR) AS id, NULL AS text, arg_min('m' || CAST(conv_id % 3 AS VARCHAR), turn) FILTER (WHERE role = 'assistant') AS model, '/work/' || CAST(conv_id AS VARCHAR) AS cwd FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT CAST(conv_id AS VARCHAR), row_number() OVER (PARTITION BY conv_id ORDER BY turn), CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'compaction' END, 't' || CAST(turn AS VARCHAR),
         CASE WHEN role IN ('user', 'assistant') THEN text END, CASE WHEN role = 'assistant' THEN 'm' || CAST(conv_id % 3 AS VARCHAR) END, NULL FROM conversations)"""
_PI = """messages AS (
  SELECT CAST(conv_id AS VARCHAR) AS sid, conv_id, turn, CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'compaction' END AS type, 't' || CAST(turn AS VARCHAR) AS id, CASE WHEN role IN ('user', 'assistant') THEN text END AS text FROM conversations WHERE conv_id % 3 <> 0
), logged AS (
  SELECT sid, 0 AS seq, 'session_start' AS type, sid AS id, NULL AS text, NULL AS content, CASE WHEN conv_id % 2 = 0 THEN 'm' || CAST(conv_id % 3 AS VARCHAR) END AS model FROM messages GROUP BY sid, conv_id
  UNION ALL
  SELECT sid, 1, 'custom_message', 'mc', NULL, 'acme/m' || CAST(conv_id % 3 AS VARCHAR), NULL FROM messages WHERE conv_id % 2 = 0 GROUP BY sid, conv_id
  UNION ALL
  SELECT sid, row_number() OVER (PARTITION BY conv_id ORDER BY turn) + CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END, type, id, text, NULL, CASE WHEN type = 'assistant_message' THEN 'm' || CAST(conv_id % 3 AS VARCHAR) END FROM messages)"""


def _logged(spark, d, kind):
    return logs.parse_logs(tables.conversation_logs(spark, d, kind), source={"pi": "pi"}.get(kind))  # a pi log without its header isn't known by itself


@query("claude_log_events", f"WITH {_CLAUDE} SELECT * FROM logged")
def claude_log_events(spark, d):
    """Parsing, with the header's model taken from the first reply."""
    return _logged(spark, d, "claude").select("sid", "seq", "type", "id", "text", "model", "cwd")


@query("pi_log_events", f"WITH {_PI} SELECT * FROM logged")
def pi_log_events(spark, d):
    """Parsing, the header's model from a change of it, and no events of logs without a header."""
    return _logged(spark, d, "pi").select("sid", "seq", "type", "id", "text", "content", "model")


@query("log_run_stats", f"WITH {_PI} SELECT count(DISTINCT sid) FILTER (WHERE type = 'session_start') AS sessions_found, count(DISTINCT sid) AS sessions_written, count(*) AS events_written FROM logged")
def log_run_stats(spark, d):
    return agg.run_stats(_logged(spark, d, "pi"))


@query("log_filter_headers", f"WITH {_PI} SELECT sid, seq, type FROM logged WHERE type IN ('session_start', 'compaction')")
def log_filter_headers(spark, d):
    """Headers pass every filter of events."""
    return sel.filter_events(_logged(spark, d, "pi"), sel.Criteria(types=("compaction",))).select("sid", "seq", "type")


@query("log_sessions", f"WITH {_CLAUDE} SELECT sid, id, cwd, model FROM logged WHERE type = 'session_start' AND contains(cwd, '7')")
def log_sessions(spark, d):
    """Headers as metadata, by folder."""
    events = sel.in_folder_and_time(_logged(spark, d, "claude"), cwd="7")
    return sel.admitted(events).where("type = 'session_start'").select("sid", "id", "cwd", "model")


@query("log_context", f"WITH {_PI}, runs AS (SELECT * FROM logged) SELECT sid, seq, CAST(1 AS BIGINT) AS run_no, CAST(sum(CASE WHEN type = 'user_message' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS turn_no, CAST(sum(CASE WHEN type = 'compaction' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS segment, coalesce(last_value(CASE WHEN type IN ('session_start', 'assistant_message') THEN model END IGNORE NULLS) OVER w, '') AS active_model FROM runs WINDOW w AS (PARTITION BY sid ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def log_context(spark, d):
    """Turns, segments and the active model, which a header sets."""
    return ctx.with_context(_logged(spark, d, "pi")).select("sid", "seq", "run_no", "turn_no", "segment", "active_model")


@query("log_last_turns", f"WITH {_PI}, c AS (SELECT *, sum(CASE WHEN type = 'user_message' THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY seq) AS t FROM logged), m AS (SELECT sid, max(t) AS last FROM c GROUP BY sid) SELECT c.sid, c.seq, c.type FROM c JOIN m ON c.sid = m.sid WHERE type = 'session_start' OR (t > 0 AND t > last - 2)")
def log_last_turns(spark, d):
    """Headers and the last two turns; what comes before the first turn goes."""
    return sel.filter_events(_logged(spark, d, "pi"), sel.Criteria(last_turns=2)).select("sid", "seq", "type")


@query("codex_log_events", """WITH r AS (SELECT *, sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations),
island AS (SELECT conv_id, role, min(turn) AS turn, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, g, role), numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM island)
SELECT CAST(conv_id AS VARCHAR) AS sid, 0 AS seq, 'session_start' AS type, CAST(conv_id AS VARCHAR) AS id, NULL AS text, 'm' || CAST(conv_id % 3 AS VARCHAR) AS model FROM conversations GROUP BY conv_id
UNION ALL SELECT CAST(conv_id AS VARCHAR), seq, CASE role WHEN 'user' THEN 'user_message' WHEN 'assistant' THEN 'assistant_message' ELSE 'compaction' END, 'e' || CAST(seq - 1 AS VARCHAR), CASE WHEN role IN ('user', 'assistant') THEN text END, CASE WHEN role = 'assistant' THEN 'm' || CAST(conv_id % 3 AS VARCHAR) END FROM numbered""")
def codex_log_events(spark, d):
    """Parsing, with items that follow each other gathered into one message, ids made up, and the model of a record in between."""
    return _logged(spark, d, "codex").select("sid", "seq", "type", "id", "text", "model")
