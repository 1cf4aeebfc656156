import json
import os
from datetime import datetime, timezone

import pytest

from sessiondeck.sources import json_values as jv
from sessiondeck.sources.discovery import Search, discover
from sessiondeck.sources.formats import pi_jsonl, text_export as te
from sessiondeck.sources.formats.base import HeadError, ancestry
from sessiondeck.sources.formats.codex_rollout import CodexRollout, command_kind, tool_output
from sessiondeck.sources.logs import UnknownFormat, read_logs, session_events
from sessiondeck.sources.registry import Registry, default_registry

from . import samples

R = default_registry(user_folder=None)


def events(text, name="x.jsonl", **how):
    return list(session_events(text, f"/logs/{name}", R, **how))


@pytest.mark.parametrize(("text", "want"), [
    ('{"a":1}\n{"b":2}\r\n\n[3]', [{"a": 1}, {"b": 2}, [3]]), ('{\n "a": [1,\n 2]\n}\n{"b": {}}', [{"a": [1, 2]}, {"b": {}}]), ("", []), (" \n\t", []), ('"s" 1 true null', ["s", 1, True, None]), ("12", [12]),
    ('{"a":1}{"b":2}', [{"a": 1}, {"b": 2}]),
])
def test_values_in_a_row(text, want):
    assert list(jv.json_values(text)) == want


@pytest.mark.parametrize("tail", ["{", '{"a', '{"a"', '{"a":', '{"a":1', '{"a":1,', "[", "[1,", '"x', '"x\\', '"x\\u12', "tr", "fals", "nul", "-", "1.", "1e", "1e+", '{"a":"b\\', '[{"a":[tru', "[-", "[1.5"])
def test_a_cut_tail_is_left_out(tail):
    assert list(jv.json_values('{"ok":1}\n' + tail)) == [{"ok": 1}]


@pytest.mark.parametrize(("text", "line"), [('{"a":1}\n{"a" 1}', 2), ("{\n\n x}", 3), ('{"a":1,}', 1), ("[1,]", 1), ("tx", 1), ("1.x", 1), ('"a\nb"', 1), ('{"a":"\\q"}', 1), ("12abc", 1), ("]", 1), ('{"a":1}}', 1), ("01", 1), ("NaN", 1), ('{"a":\n"b"\n"c"}', 3)])
def test_corruption_names_its_line_after_earlier_values(text, line):
    got = []
    with pytest.raises(jv.MalformedRecord, match=rf"^log:{line}: malformed JSON record$"):
        for v in jv.json_values(text, "log"):
            got.append(v)
    assert got == ([{"a": 1}] if text.startswith('{"a":1}') else got)


def test_first_value_and_lines():
    assert jv.first_json_value("not json") is None and jv.first_json_value('{"a":1} garbage') == {"a": 1} and jv.first_json_value("") is None
    assert jv.first_lines("\n a\r\n\nb\nc", 2) == [" a", "b"]
    assert list(jv.lenient_lines('{"a":1}\nbad\n\n[2]')) == [{"a": 1}, [2]]
    big = json.dumps({"x": list(range(30_000))}, indent=1)
    assert list(jv.json_values(big)) == [json.loads(big)]


def test_formats_are_detected(tmp_path):
    texts = {"claude-code": samples.jsonl(samples.CLAUDE), "pi": samples.jsonl(samples.PI), "codex": samples.jsonl(samples.CODEX), "claude-export": samples.EXPORT}
    for name, text in texts.items():
        assert R.detect(text).name == name
    assert R.detect("hello") is None
    with pytest.raises(UnknownFormat):
        events("hello")


def test_project_log():
    got = events(samples.jsonl(samples.CLAUDE), "s1.jsonl")
    assert [e["type"] for e in got] == ["session_start", "user_message", "assistant_message", "skill_invocation", "tool_result", "user_message", "error", "compaction", "user_message"]
    start, user, asst, skill, result = got[:5]
    assert (start["id"], start["cwd"], start["model"], start["git"]) == ("s1", "/work/x", "m-1", {"branch": "main"})
    assert asst["thinking"] == {"text": "hm"} and asst["usage"] == {"input": 3, "output": 4, "cacheRead": None, "cacheWrite": None}
    assert [c["normalizedName"] for c in asst["toolCalls"]] == ["terminal", "Skill"]
    assert (skill["name"], skill["path"], skill["arguments"], skill["id"]) == ("deploy", "/a/SKILL.md", {"env": "x"}, "a1:skill:t2")
    assert (result["id"], result["toolName"], result["content"], result["isError"]) == ("u2:t1", "Bash", "Exit code 2\nno", True)
    assert got[6]["code"] == "overloaded" and got[6]["message"] == "API error 529" and got[8]["text"] == "then this"


def test_sub_agents_log_keeps_its_chain():
    records = [{**r, "isSidechain": True, "agentId": "ag"} for r in samples.CLAUDE]
    got = events(samples.jsonl(records))
    assert got[0]["id"] == "ag" and got[0]["parentSession"] == "s1" and any(e.get("text") == "hidden" for e in got)


def test_a_log_without_header_gives_no_held_events():
    assert events(samples.jsonl([{"type": "user", "uuid": "u", "sessionId": "s", "message": {"content": "hi"}}])) == []


def test_rollout():
    got = events(samples.jsonl(samples.CODEX))
    assert [e["type"] for e in got] == ["session_start", "user_message", "assistant_message", "tool_result", "assistant_message", "error", "compaction", "assistant_message"]
    assert got[0]["model"] == "g-2" and got[0]["git"] == {"branch": "dev", "commit": "abc", "remote": None}
    first = got[2]
    assert (first["text"], first["thinking"], first["model"], first["id"]) == ("on it", {"summary": "think more", "text": None}, "g-1", "e1")
    assert [c["normalizedName"] for c in first["toolCalls"]] == ["file_search", "file_write"] and first["usage"]["input"] == 40 and first["usage"]["cacheRead"] == 60
    assert (got[3]["content"], got[3]["isError"], got[3]["exitCode"], got[3]["toolName"]) == ("bad", True, 2, "shell")
    assert got[4]["toolCalls"][0]["normalizedName"] == "web_fetch" and got[4]["id"] == "e4" and got[4]["toolCalls"][0]["id"] == "e3"
    assert got[5]["message"] == "stopped" and got[7]["model"] == "g-2" and "usage" not in got[7]
    assert events(samples.jsonl(samples.CODEX[1:]), source="codex") == []


def test_shell_commands_and_outputs():
    assert [command_kind(c) for c in ("cat a", " rg --files", "find .", "grep x", "catalog x", "make")] == ["file_read", "file_search", "file_search", "content_search", "terminal", "terminal"]
    assert tool_output("Process exited with code 4") == ("Process exited with code 4", True, 4)
    assert tool_output("fine") == ("fine", False, None) and tool_output(None) == ('""', False, None)
    assert CodexRollout().normalize("apply_patch", {"input": "x"}) == "file_edit"


def test_tree_log():
    got = events(samples.jsonl(samples.PI))
    assert [e["type"] for e in got] == ["session_start", "custom_message", "user_message", "skill_invocation", "assistant_message", "tool_result", "custom_message", "compaction", "custom_message", "user_message", "assistant_message", "assistant_message"]
    assert got[0]["model"] == "big" and got[3]["path"] == "/s/SKILL.md" and got[4]["usage"]["costUsd"] == 0.5
    assert got[6]["content"] == "$ ls (exit 0)\nx" and got[8]["content"] == ["/A.md"] and got[8]["id"] == "k1:instructions"
    assert events(samples.jsonl(samples.PI[1:]), source="pi") == []


@pytest.mark.parametrize(("text", "want"), [
    ('<skill name="a" location="/x/SKILL.md">', {"name": "a", "path": "/x/SKILL.md"}), ("\n<skill location='SKILL.md' name='b'/>", {"name": "b", "path": "SKILL.md"}), ('<skill name="a" name="b" location="SKILL.md">', None),
    ('<skills name="a" location="SKILL.md">', None), ('<skill name="a">', None), ('<skill name="a" location="x.md">', None), ('hi <skill name="a" location="SKILL.md">', None), ('<skill name="a"location="SKILL.md">', None), ('<skill name="a" location="SKILL.md"', None),
])
def test_skill_envelopes(text, want):
    assert pi_jsonl.skill_envelope(text) == want


def test_heads():
    text = samples.jsonl(samples.PI)
    assert [e["id"] for e in events(text, head="alt")] == ["p1", "m", "u1", "u1:skill", "alt"]
    assert [e["id"] for e in events(text, head="a1")][-1] == "a1"
    for bad in ("nope", " "):
        with pytest.raises(HeadError):
            events(text, head=bad)
    with pytest.raises(HeadError, match="does not support"):
        events(samples.jsonl(samples.CODEX), head="x")
    with pytest.raises(HeadError, match="duplicate"):
        ancestry([{"id": "a", "parentId": None}, {"id": "a", "parentId": None}], "a")
    with pytest.raises(HeadError, match="cycle"):
        ancestry([{"id": "a", "parentId": "b"}, {"id": "b", "parentId": "a"}], "a")
    assert [e["id"] for e in ancestry([{"id": "x", "parentId": None}, {"id": "b", "parentId": "gone"}, {"id": "c", "parentId": "b"}], "c")] == ["b", "c"]
    claude = events(samples.jsonl(samples.CLAUDE), head="a1")
    assert [e["id"] for e in claude] == ["s1", "u1", "a1", "a1:skill:t2"]


def test_text_export():
    got = events(samples.EXPORT, "2026-06-12-115439-look.txt")
    assert [e["type"] + ":" + e.get("customType", "") for e in got] == [
        "session_start:", "custom_message:export_fidelity", "user_message:", "assistant_message:", "assistant_message:", "tool_result:", "assistant_message:", "tool_result:", "tool_result:", "custom_message:collapsed_tools",
        "custom_message:user_answers", "custom_message:recap",
    ]
    assert (got[0]["id"], got[0]["timestamp"], got[0]["model"], got[0]["cwd"]) == ("2026-06-12-115439-look", "2026-06-12T11:54:39", "Model Z", "~/work/e")
    assert got[2]["text"] == "please do this\nthing" and got[3]["text"].endswith("this text which wraps.")
    assert got[4]["toolCalls"][0]["arguments"] == {"command": "ls -la"} and got[5]["isError"] and got[5]["content"].endswith("…[truncated]")
    assert [c["id"] for c in got[6]["toolCalls"]] == ["t2", "t3"] and [r["isError"] for r in got[7:9]] == [False, True]
    assert got[10]["content"] == "· One → yes\n· Two → no" and got[11]["content"] == "all good"
    assert [e["parentId"] for e in got[1:4]] == ["2026-06-12-115439-look", "e1", "e2"]
    assert te.without_box("╭───╮\n│ a │\n│   │\n│   │\n│ b │\n╰───╯") == "a\nb" and te.unwrap(["- a", "- b", "", "", "", "c"]) == "- a\n- b\n\nc"


def test_registry_keeps_places_and_loads_files(tmp_path, capsys):
    path = samples.write(tmp_path, "mine.py", "from sessiondeck.sources.formats.pi_jsonl import PiJsonl\nclass Mine(PiJsonl):\n    name = 'mine'\nFORMAT = Mine()\n")
    r = default_registry([path], user_folder=None)
    assert [f.name for f in r.all()] == ["claude-code", "codex", "claude-export", "pi", "mine"]
    r.register(type("Again", (CodexRollout,), {})())
    assert [f.name for f in r.all()][1] == "codex"
    assert r.load_file(samples.write(tmp_path, "bad.py", "1/0")) is None and "warning" in capsys.readouterr().err
    with pytest.raises(TypeError):
        Registry().register(object())


def test_discovery(tmp_path):
    root = str(tmp_path)
    a = samples.write(root, "-work-x/s1.jsonl", samples.jsonl(samples.CLAUDE[1:]))
    b = samples.write(root, "-work-x/subagents/s2.jsonl", samples.jsonl(samples.CLAUDE))
    samples.write(root, "-work-x/deep/s3.jsonl", "{}")
    samples.write(root, "-work-x/note.md", "x")
    os.utime(a, (0, datetime(2026, 1, 2, tzinfo=timezone.utc).timestamp()))
    find = lambda **how: [os.path.relpath(p, root) for p in discover(R, Search(sessions_dir=root, source="claude-code", **how))]
    assert find() == ["-work-x/s1.jsonl"]
    assert find(include_subagents=True) == ["-work-x/s1.jsonl", os.path.relpath(b, root)]
    assert find(cwd="WORK/X") == ["-work-x/s1.jsonl"] and find(cwd="other") == []
    at = lambda d, h=0: datetime(2026, 1, d, h, tzinfo=timezone.utc)
    assert find(since=at(3)) == [] and find(since=at(1), until=at(2, 1)) == ["-work-x/s1.jsonl"] and find(until=at(1, 23)) == []
    dated = samples.write(root, "y/z/rollout-2026-03-01T00-00-00-c1.jsonl", samples.jsonl(samples.CODEX))
    dates = lambda **how: list(discover(R, Search(sessions_dir=root, source="codex", **how)))
    assert dates(since=datetime(2026, 3, 1, 20, tzinfo=timezone.utc), until=datetime(2026, 3, 1, 1, tzinfo=timezone.utc)) == [dated]
    assert dates(since=datetime(2026, 3, 2, tzinfo=timezone.utc)) == [] and list(discover(R, Search(sessions_dir="/nowhere", source="pi"))) == []


def test_read_logs(spark, tmp_path):
    paths = samples.all_logs(str(tmp_path))
    df = read_logs(spark, list(paths.values()))
    counts = {r["sid"]: r["count"] for r in df.groupBy("sid").count().collect()}
    assert counts == {"s1": 9, "p1": 12, "c1": 8, "2026-06-12-115439-look": 12}
    assert df.where("type = 'session_start'").select("path").collect()[0]["path"] in paths.values()
    assert read_logs(spark, []).count() == 0
    bad = samples.write(tmp_path, "bad.jsonl", samples.jsonl(samples.PI[:4]) + "{oops}\n")
    with pytest.raises(Exception, match="bad.jsonl:5: malformed JSON record"):
        read_logs(spark, bad).count()
    assert read_logs(spark, bad, mode="permissive").count() == 5
    with pytest.raises(ValueError, match="unknown source"):
        read_logs(spark, bad, source="nope")


def test_values_of_parts_are_those_of_the_whole():
    import random

    rng = random.Random(1)
    texts = [
        '{"a": [1, 2, {"b": "x\\n"}]}\n\n[1,2]\n"s" 12 3.5e2\ntrue null\n', json.dumps({"k": list(range(30_000))}, indent=1) + "\n{}", '{"a":1}\n{"b": tru', '{"a":1}{"b":2}', "12", "1 2 3", "", "  \n",
        '{"a":1}\n{"b":2}\n{bad}\n{"c":3}\n', '{"a":1}\n12x\n', '["\\ud83d\\ude00", "é"]\n',
    ]
    for text in texts:
        for size in (1, 7, 5000):
            if size == 1 and len(text) > 1000:
                continue
            cuts = [text[i : i + size + (size > 1) * rng.randint(0, 3)] for i in range(0, len(text), size)] if size == 1 else [text[i : i + size] for i in range(0, len(text), size)]

            def read(x):
                out = []
                try:
                    for v in jv.json_values(x, "f"):
                        out.append(v)
                except jv.MalformedRecord as e:
                    out.append(str(e))
                return out

            assert read(iter(cuts)) == read(text), (text[:60], size)


def test_large_logs_are_read_by_lines(spark, tmp_path):
    paths = list(samples.all_logs(str(tmp_path)).values())
    more = samples.write(str(tmp_path), "pretty.jsonl", "\n".join(json.dumps(x, indent=2) for x in samples.PI).replace("p1", "p9") + '\n{"type": "mess')
    want = read_logs(spark, [*paths, more]).orderBy("sid", "seq").collect()
    assert read_logs(spark, [*paths, more], large=0).orderBy("sid", "seq").collect() == want
    bad = samples.write(str(tmp_path), "bad.jsonl", samples.jsonl(samples.PI[:3]) + "{bad}\n" + samples.jsonl(samples.PI[3:]))
    with pytest.raises(Exception, match="bad.jsonl:4: malformed JSON record"):
        read_logs(spark, bad, large=0).count()
    assert read_logs(spark, bad, large=0, mode="permissive").count() == read_logs(spark, bad, mode="permissive").count() > 0
