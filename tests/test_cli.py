import glob
import json
import os

import pytest

from sessiondeck import api, cli, sinks
from sessiondeck.plans import reports

from . import samples


@pytest.fixture
def logs(tmp_path):
    return samples.all_logs(str(tmp_path / "in"))


def run(spark, capsys, *argv):
    code = cli.main(list(argv), spark)
    out = capsys.readouterr()
    return code, out.out, out.err


def test_one_log_to_lines(spark, capsys, logs):
    code, out, err = run(spark, capsys, logs["pi"])
    events = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and [e["id"] for e in events][:3] == ["p1", "m", "u1"] and len(events) == 12 and err.startswith("scanned 1 sessions, wrote 1 (12 events)")


def test_head_turns_and_thinking(spark, capsys, logs):
    code, out, _ = run(spark, capsys, logs["pi"], "--head", "a2", "--last-turns", "1", "--tool-results", "errors", "--no-thinking")
    assert code == 0 and [json.loads(x)["id"] for x in out.splitlines()] == ["p1", "u2", "a2"]
    code, out, err = run(spark, capsys, logs["pi"], "--head", "none")
    assert code == 1 and "was not found" in err


def test_skill_that_isnt_there_writes_nothing(spark, capsys, logs):
    code, out, err = run(spark, capsys, logs["pi"], "--skill", "nope")
    assert code == 0 and out == "" and "scanned 1 sessions, wrote 0 (0 events)" in err


@pytest.mark.parametrize("argv", [
    ["a", "b"], [" "], ["--last-turns", "0"], ["--last-turns", "1.5"], ["--last-turns", "99999999999999999"], ["--tool-lines", "-1"], ["--tool-lines", "01"], ["--type", "x"], ["--type", ""], ["--role", "system"], ["--tool", "a,,b"],
    ["--skill", ","], ["--tool-results", "failed"], ["--format", "xml"], ["--out", "a", "--out-dir", "b"], ["--out", " "], ["--cwd", ""], ["--source", "nope"], ["--since", "2026-02-30"], ["--since", "x"], ["--since", "2026-02-02", "--until", "2026-02-01"],
    ["--head", "x"], ["a", "--head", " "], ["a", "--head", "null"], ["--unknown"], ["--adapter", "/nowhere.py"],
])
def test_usage_errors_come_before_any_work(capsys, argv):
    assert cli.main(argv, spark="unused") == 2
    assert "sessiondeck: " in capsys.readouterr().err


def test_missing_and_malformed_inputs(spark, capsys, tmp_path):
    assert run(spark, capsys, str(tmp_path / "none.jsonl"))[0] == 1
    bad = samples.write(tmp_path, "bad.jsonl", samples.jsonl(samples.PI[:3]) + "{x}\n")
    code, _, err = run(spark, capsys, bad)
    assert code == 1 and "bad.jsonl:4: malformed JSON record" in err
    code, _, err = run(spark, capsys, samples.write(tmp_path, "what.txt", "hello"))
    assert code == 1 and "unknown session format" in err


def test_files_are_never_overwritten(spark, capsys, logs, tmp_path):
    out = str(tmp_path / "new" / "out.md")
    assert run(spark, capsys, logs["claude"], "--format", "md", "--out", out)[0] == 0
    assert open(out).read().startswith("# session s1\n")
    assert run(spark, capsys, logs["claude"], "--out", out)[0] == 1
    assert run(spark, capsys, logs["claude"], "--out", logs["claude"])[0] == 1
    assert run(spark, capsys, logs["claude"], "--out-dir", os.path.dirname(logs["claude"]))[0] == 1


def test_a_file_for_each_session(spark, logs, tmp_path):
    stats = api.run(spark, [logs["pi"], logs["codex"]], out_dir=str(tmp_path / "out"))
    assert (stats.sessions_found, stats.sessions_written, stats.events_written) == (2, 2, 20)
    assert sorted(os.listdir(tmp_path / "out")) == ["c1.jsonl", "p1.jsonl"]
    for bad in ("", ".", "..", "a/b", "a\\b", "c:d", "x\0"):
        with pytest.raises(sinks.SinkError):
            sinks.session_path("/tmp/o", bad, "md")


def test_logs_keep_their_order(spark, logs, tmp_path, capsys):
    api.run(spark, [logs["pi"], logs["claude"], logs["codex"]], out=str(tmp_path / "all.jsonl"))
    sids = [json.loads(x)["sid"] for x in open(tmp_path / "all.jsonl")]
    assert list(dict.fromkeys(sids)) == ["p1", "s1", "c1"]


def test_discovery_by_flags(spark, capsys, tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    samples.write(tmp_path, ".pi/agent/sessions/-work-p/2026-02-01T00_p1.jsonl", samples.jsonl(samples.PI))
    code, out, err = run(spark, capsys, "--cwd", "work/p", "--since", "2026-01-31", "--source", "pi", "--error")
    assert code == 0 and [json.loads(x)["id"] for x in out.splitlines()] == ["p1", "r1"]
    assert run(spark, capsys, "--cwd", "elsewhere", "--since", "2026-01-31")[2].startswith("scanned 0 sessions")
    assert cli.project("/home/a/src/proj/x") == "proj" and cli.project("/home/a/thing") == "thing"


def test_scanner_file(spark, capsys, logs, tmp_path):
    path = samples.write(tmp_path, "scan.py", "def scan_session(events, session):\n    yield {'type': 'custom_message', 'customType': 'n', 'n': len(events)}\n")
    code, out, _ = run(spark, capsys, logs["pi"], "--scanner", path)
    lines = [json.loads(x) for x in out.splitlines()]
    assert code == 0 and [x["type"] for x in lines] == ["session_start", "custom_message"] and lines[1]["n"] == 11
    assert run(spark, capsys, logs["pi"], "--scanner", samples.write(tmp_path, "none.py", "x = 1"))[0] == 1


def test_closed_output_is_no_failure():
    class Closed:
        def write(self, _):
            raise BrokenPipeError

    import sys

    real = sys.stdout
    try:
        sys.stdout = open(os.devnull, "w")
        with pytest.raises(sinks.ClosedOutput):
            sinks.to_stdout(["x"], Closed())
    finally:
        sys.stdout = real


def test_library_call(spark, logs):
    got = api.scan_session(spark, logs["pi"], head="alt").orderBy("seq").collect()
    assert [r["id"] for r in got] == ["p1", "m", "u1", "u1:skill", "alt"] and got[-1]["turn_no"] == 1


def test_partitioned_table(spark, logs, tmp_path):
    from sessiondeck import render

    sinks.write_table(render.ndjson(api.read_many(spark, [logs["pi"], logs["codex"]])), str(tmp_path / "t"))
    assert len(glob.glob(str(tmp_path / "t" / "sid=*"))) == 2


def test_branch_reports(spark, tmp_path):
    root = str(tmp_path / "s")
    samples.write(root, "--Users-me-src-app-feat-login--/b.jsonl", samples.jsonl(samples.PI) + "broken\n")
    samples.write(root, "--Users-me-src-app-fix-bug--/a.jsonl", samples.jsonl(samples.PI[:1]))
    samples.write(root, "--Users-me-src-app-fix-bug--/void.jsonl", samples.jsonl(samples.PI[2:]))
    samples.write(root, "other/c.jsonl", samples.jsonl(samples.PI))
    made = reports.write_first_turn_reports(spark, root, str(tmp_path / "out"), "now")
    assert open(made[0]).read().splitlines()[1:] == ["feat\tlogin\tb\t2026-02-01T00:00:00Z\t0\t1\t1\t20\t10\t5", "feat\tlogin\tb\t2026-02-01T00:00:00Z\t1\t2\t0\t2\t1\t0"]
    assert [x.split("\t")[:5] for x in open(made[1]).read().splitlines()[1:]] == [["feat", "login", "b", "2026-02-01T00:00:00Z", "0"], ["feat", "login", "b", "2026-02-01T00:00:00Z", "1"], ["fix", "bug", "a", "2026-02-01T00:00:00Z", "0"]]
    text = open(made[2]).read()
    assert "first-turns analyzed: **2** (feat: 2, fix: 0)" in text and "| output_tokens | 11 | 20 | 20 | 20 | 20 |" in text and "### fix (n=0 first-turns)" in text


def test_session_report(spark, tmp_path):
    root = str(tmp_path)
    samples.write(root, "export/main-thread.jsonl", samples.jsonl(samples.CLAUDE))
    samples.write(root, "export/subagents/x.jsonl", samples.jsonl([{**r, "isSidechain": True, "agentId": "agent-one-long-name"} for r in samples.CLAUDE]))
    config = {"title": "T", "exportDir": "export", "out": "report.md", "mainId": "s1", "agents": {"agent-one-long-name": ["fix", "Label WATCHDOG"]}, "phases": [{"title": "P1", "ids": ["agent-one-long-name"], "win": ["2026-01-02T10", None]}, {"title": "P2", "ids": [], "win": [None, None]}]}
    path = samples.write(root, "config.json", json.dumps(config))
    text = open(reports.write_session_report(spark, path)).read()
    assert "- **Sessions:** 2 (1 main + 1 sub-agents)." in text and "- **Wall-clock:** 10:00 → 10:00 UTC (2026-01-02)." in text
    assert "**Main-thread tool calls** (2)\n`Bash ×1  Skill ×1`\n\nfailed (1):\n```\nBash    ls  ❌ bash-exit-2\n```" in text
    assert "**What went wrong / went off**\n- `agent-one-lo` implementer **watchdog-killed** mid-run; a retry agent re-did the work.\n- `agent-one-lo` is a **fix wave** — the preceding" in text
    assert text.count("### Assessment\n<!-- pending -->") == 2 and text.endswith("## Narrative & assessment\n\n### What went well\n<!-- pending -->\n\n### Where the agent went off (root causes)\n<!-- pending -->\n\n### Reviewer verdicts (per task)\n<!-- pending -->\n\n### Recommendations\n<!-- pending -->\n")
    assert "- `agent-one-lo` [fix] Label WATCHDOG — m-1 (2 turns, 1 tools, 1 errors)" in text and "| bash-exit-2 | 2 |\n| **total** | **2** |" in text and "**[INSTRUCTION]** fix it" in text
