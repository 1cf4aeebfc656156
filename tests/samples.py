"""Small logs of each format, of our own making."""

import json
import os

CLAUDE = [
    {"type": "mode", "sessionId": "s1"},
    {"type": "user", "uuid": "u1", "parentUuid": None, "timestamp": "2026-01-02T10:00:00Z", "sessionId": "s1", "cwd": "/work/x", "gitBranch": "main", "message": {"role": "user", "content": "fix it"}},
    {"type": "assistant", "uuid": "a1", "parentUuid": "u1", "timestamp": "2026-01-02T10:00:05Z", "sessionId": "s1", "message": {"model": "m-1", "stop_reason": "tool_use", "usage": {"input_tokens": 3, "output_tokens": 4, "cache_read_input_tokens": 0},
        "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "looking"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}, {"type": "tool_use", "id": "t2", "name": "Skill", "input": {"skill": "deploy", "path": "/a/SKILL.md", "env": "x"}}]}},
    {"type": "user", "uuid": "u2", "parentUuid": "a1", "timestamp": "2026-01-02T10:00:06Z", "sessionId": "s1", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "Exit code 2\nno"}], "is_error": True}, {"type": "text", "text": "and more"}]}},
    {"type": "assistant", "uuid": "side", "isSidechain": True, "message": {"content": [{"type": "text", "text": "hidden"}]}},
    {"type": "user", "uuid": "u3", "isMeta": True, "message": {"content": "meta"}},
    {"type": "user", "uuid": "u4", "message": {"content": "[Request interrupted by user]"}},
    {"type": "system", "subtype": "api_error", "uuid": "e", "error": {"status": 529, "error": {"error": {"type": "overloaded"}}}, "retryAttempt": 1, "maxRetries": 3},
    {"type": "system", "subtype": "compact_boundary", "uuid": "c"},
    {"type": "attachment", "uuid": "q", "attachment": {"type": "queued_command", "prompt": "then this"}},
]
PI = [
    {"type": "session", "id": "p1", "timestamp": "2026-02-01T00:00:00Z", "cwd": "/work/p"},
    {"type": "model_change", "id": "m", "parentId": None, "provider": "acme", "modelId": "big", "timestamp": "2026-02-01T00:00:01Z"},
    {"type": "message", "id": "u1", "parentId": "m", "timestamp": "2026-02-01T00:00:02Z", "message": {"role": "user", "content": [{"type": "text", "text": '<skill name="deploy" location="/s/SKILL.md">do</skill>'}]}},
    {"type": "message", "id": "a1", "parentId": "u1", "timestamp": "2026-02-01T00:00:03Z", "message": {"role": "assistant", "provider": "acme", "model": "big", "stopReason": "stop", "content": [{"type": "text", "text": "ok"}, {"type": "toolCall", "id": "c1", "name": "bash", "arguments": {"command": "bun test widget"}}], "usage": {"input": 10, "output": 20, "cacheRead": 5, "totalTokens": 35, "cost": {"total": 0.5}}}},
    {"type": "message", "id": "r1", "parentId": "a1", "timestamp": "2026-02-01T00:00:04Z", "message": {"role": "toolResult", "toolCallId": "c1", "toolName": "bash", "content": [{"type": "text", "text": "FAILED widget\nline 2\nline 3"}], "isError": True}},
    {"type": "message", "id": "b1", "parentId": "r1", "message": {"role": "bashExecution", "command": "ls", "output": "x", "exitCode": 0}},
    {"type": "compaction", "id": "k1", "parentId": "b1", "summary": "so far", "tokensBefore": 99, "systemMessage": {"sections": {"project_context": '<project_instructions path="/A.md">'}}},
    {"type": "message", "id": "u2", "parentId": "k1", "message": {"role": "user", "content": "no"}},
    {"type": "message", "id": "a2", "parentId": "u2", "message": {"role": "assistant", "content": [{"type": "text", "text": "sorry"}], "model": "small", "usage": {"input": 1, "output": 2}}},
    {"type": "message", "id": "alt", "parentId": "u1", "message": {"role": "assistant", "content": [{"type": "text", "text": "other branch"}]}},
]
CODEX = [
    {"timestamp": "2026-03-01T00:00:00Z", "type": "session_meta", "payload": {"id": "c1", "cwd": "/work/c", "originator": "cli", "git": {"branch": "dev", "commit_hash": "abc"}}},
    {"timestamp": "2026-03-01T00:00:01Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "<environment_context>x"}]}},
    {"timestamp": "2026-03-01T00:00:02Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"text": "go"}]}},
    {"timestamp": "2026-03-01T00:00:03Z", "type": "turn_context", "payload": {"model": "g-1"}},
    {"timestamp": "2026-03-01T00:00:04Z", "type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "think"}, {"text": "more"}]}},
    {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"text": "on it"}]}},
    {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": '{"command":["rg","--files","x"]}', "call_id": "f1"}},
    {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "apply_patch", "input": "*** Add File: a", "call_id": "f2"}},
    {"type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": 100, "cached_input_tokens": 60, "output_tokens": 7, "total_tokens": 107}}}},
    {"timestamp": "2026-03-01T00:00:05Z", "type": "response_item", "payload": {"type": "function_call_output", "call_id": "f1", "output": '{"output":"bad","metadata":{"exit_code":2}}'}},
    {"type": "response_item", "payload": {"type": "web_search_call", "action": {"type": "open_page", "url": "http://x"}}},
    {"type": "event_msg", "payload": {"type": "turn_aborted", "reason": "stopped"}},
    {"type": "compacted", "payload": {}},
    {"type": "turn_context", "payload": {"model": "g-2"}},
    {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"text": "done"}]}},
]
EXPORT = """ ▐▛███▜▌   Claude Code v9.9
▝▜█████▛▘  Model Z · Plan
  ▘▘ ▝▝    ~/work/e

❯ please do this
  thing

⏺ I will look at the file and then go on to the other part of this text
  which wraps.

⏺ Bash(ls -la)
  ⎿  error: not found
     … +3 lines (ctrl+o to expand)

⏺ 2 explore agents finished (ctrl+o to expand)
   ├ Find a · 3 tool uses
   │ ⎿  Done
   └ Find b · 1 tool use
     ⎿  failed to run

  Read 2 files (ctrl+o to expand)

⏺ User answered the questions:
  ⎿  · One → yes
     · Two → no

✻ Brewed for 3s

※ recap: all good
"""


def jsonl(records):
    return "".join(json.dumps(r) + "\n" for r in records)


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def all_logs(folder):
    return {
        "claude": write(folder, "s1.jsonl", jsonl(CLAUDE)), "pi": write(folder, "2026-02-01T00-00-00_p1.jsonl", jsonl(PI)),
        "codex": write(folder, "rollout-2026-03-01T00-00-00-c1.jsonl", jsonl(CODEX)), "export": write(folder, "2026-06-12-115439-look.txt", EXPORT),
    }
