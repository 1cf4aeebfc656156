"""Rollout logs: records of a timestamp, a type and a payload.

One response of the model comes as several items (reasoning, texts, calls). They gather in one message, which ends at the
next thing that isn't of the model: a user's text, a tool's output, a compaction, an abort, or the end. Counts of tokens
come in the order of the messages and are dealt to them by position. The model of the header is the last one named.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from typing import Any

from ...schema import FORMAT_VERSION, dumps
from ..json_values import json_values
from .base import Event, Format, Layout, first_set, joined_text, number, record, skill_of, string

#: Beginnings of texts that the agent puts before the user's.
INJECTED = ("<environment_context>", "<user_instructions>", "# AGENTS.md")
#: What a shell command does, by its first word; the first that fits.
COMMANDS = (
    (r"(cat|head|tail|less|more|nl)\s", "file_read"),
    (r"rg\s.*--files", "file_search"),
    (r"(find|fd|ls)\s", "file_search"),
    (r"(rg|grep|ag|ack)\s", "content_search"),
)


def command_kind(command: str) -> str:
    c = command.strip()
    return next((kind for pattern, kind in COMMANDS if re.match(pattern, c)), "terminal")


def tool_output(output: Any) -> tuple[str, bool, int | None]:
    """Text, whether it failed, and the exit code."""
    text, code = output if isinstance(output, str) else dumps("" if output is None else output), None
    try:
        told = json.loads(text)
    except ValueError:
        told = None
    if isinstance(told, dict):
        text = told["output"] if isinstance(told.get("output"), str) else text
        code = number(record(told.get("metadata")).get("exit_code"))
    if code is None and (m := re.search(r"Process exited with code ([0-9]+)", text)):
        code = int(m[1])
    return text, bool(code), code


def call_arguments(value: Any, parsed: bool) -> Any:
    """A call's arguments as an object; parsed: a string is JSON if it can be."""
    if isinstance(value, str):
        if parsed:
            try:
                return json.loads(value)
            except ValueError:
                pass
        return {"raw": value}
    return value if isinstance(value, (dict, list)) else {}


def reasoning(summary: Any) -> str:
    if isinstance(summary, str):
        try:
            summary = json.loads(summary)
        except ValueError:
            return summary
    if not isinstance(summary, list):
        return ""
    texts = (record(s).get("text") for s in summary)
    return " ".join(t for t in texts if isinstance(t, str) and t)


def usage_of(told: Any) -> Event | None:
    """Their input includes what was cached; ours doesn't."""
    if not isinstance(told, (dict, list)):
        return None
    u = record(told)
    cached = u.get("cached_input_tokens") or 0
    return {"input": max(0, (u.get("input_tokens") or 0) - cached), "output": u.get("output_tokens"), "cacheRead": cached or None, "reasoningOutput": u.get("reasoning_output_tokens") or None, "total": u.get("total_tokens")}


class Rollout:
    """The state while one log is read."""

    def __init__(self, path: str) -> None:
        self.path, self.header, self.at, self.names = path, None, "", 0
        self.model: str | None = None
        self.events: list[Event] = []
        self.messages: list[Event] = []
        self.usages: list[Event] = []
        self.calls: dict[str, str] = {}
        self.open: Event | None = None  # the message that gathers items

    def next_id(self) -> str:
        self.names += 1
        return f"e{self.names - 1}"

    def emit(self, **event: Any) -> None:
        self.close()
        self.events.append({"id": self.next_id(), "parentId": None, "timestamp": self.at, **event})

    def gather(self) -> Event:
        if self.open is None:
            self.open = {"type": "assistant_message", "id": self.next_id(), "parentId": None, "timestamp": self.at, "text": [], "thinking": None, "toolCalls": [], "provider": "openai"}
        return self.open

    def close(self) -> None:
        if self.open is None:
            return
        message, self.open = self.open, None
        message |= {"text": "\n".join(message["text"]), "model": self.model or ""}
        self.events.append(message)
        self.messages.append(message)
        for c in message["toolCalls"]:
            if c["name"] == "Skill" and (skill := skill_of(c["arguments"], ["skill", "name"], located=True)):
                self.events.append({"type": "skill_invocation", "id": self.next_id(), "parentId": message["id"], "timestamp": message["timestamp"], "sourceEventId": message["id"], **skill})

    def call(self, name: str, arguments: Any, own: Any) -> None:
        # a call without an id takes one before its message does
        own = self.next_id() if own is None else string(own)
        self.calls[own] = name
        self.gather()["toolCalls"].append({"id": own, "name": name, "arguments": arguments})

    def read(self, raw: dict[str, Any]) -> None:
        self.at = string(raw["timestamp"]) if raw.get("timestamp") is not None else self.at
        payload = record(raw.get("payload"))
        kind = raw.get("type")
        if kind == "session_meta":
            git = payload.get("git")
            self.model = string(payload["model"]) if payload.get("model") else None
            self.header = {
                "type": "session_start", "formatVersion": FORMAT_VERSION, "path": self.path, "agent": "codex", "id": string(first_set(payload.get("id"), "")), "timestamp": self.at, "cwd": string(first_set(payload.get("cwd"), "")),
                "git": {ours: string(record(git)[theirs]) if record(git).get(theirs) else None for ours, theirs in (("branch", "branch"), ("commit", "commit_hash"), ("remote", "repository_url"))} if git else None,
            }
        elif kind == "turn_context":
            if payload.get("model"):
                self.model = string(payload["model"])
        elif kind == "compacted":
            self.emit(type="compaction")
        elif kind == "event_msg":
            self.event(payload)
        elif kind == "response_item":
            self.item(payload)

    def event(self, payload: dict[str, Any]) -> None:
        match payload.get("type"):
            case "turn_aborted":
                self.emit(type="error", code="turn_aborted", message=string(first_set(payload.get("reason"), "interrupted")), retryable=False)
            case "context_compacted":
                self.emit(type="compaction")
            case "token_count":
                usage = usage_of(record(payload.get("info")).get("last_token_usage"))
                if usage:
                    self.usages.append(usage)

    def item(self, payload: dict[str, Any]) -> None:
        match payload.get("type"):
            case "message":
                role, text = payload.get("role"), joined_text(payload.get("content"), typed=False)
                if role == "user" and text and not text.strip().startswith(INJECTED):
                    self.emit(type="user_message", text=text)
                elif role == "assistant" and text:
                    self.gather()["text"].append(text)
            case "reasoning":
                self.gather()["thinking"] = {"summary": reasoning(payload.get("summary")) or None, "text": None}
            case "function_call" | "custom_tool_call" as how:
                arguments = call_arguments(payload.get("arguments"), True) if how == "function_call" else call_arguments(payload.get("input"), False)
                self.call(string(first_set(payload.get("name"), "")), arguments, payload.get("call_id"))
            case "web_search_call":
                self.call("web_search", first_set(payload.get("action"), {}), payload.get("call_id"))
            case "function_call_output" | "custom_tool_call_output":
                own = string(first_set(payload.get("call_id"), ""))
                content, failed, code = tool_output(payload.get("output"))
                self.emit(type="tool_result", toolCallId=own, toolName=self.calls.get(own, ""), content=content, isError=failed, exitCode=code)


class CodexRollout(Format):
    name = "codex"
    in_parts = True
    layout = Layout(
        match=lambda name: name.startswith("rollout-") and name.endswith(".jsonl"),
        recursive=True,
        date_of=lambda name: name[8:18],
        cwd_of=lambda first, folder: string(first_set(record(record(first).get("payload")).get("cwd"), "")),
    )

    def folder(self) -> str:
        return os.path.join(os.environ.get("HOME") or "~", ".codex", "sessions")

    def detect(self, first: Any, text: str) -> bool:
        payload = record(record(first).get("payload"))
        return record(first).get("type") == "session_meta" or any(isinstance(payload.get(k), str) for k in ("originator", "cli_version"))

    def parse(self, text: str, path: str) -> Iterator[Event]:
        state = Rollout(path)
        for value in json_values(text, path):
            state.read(record(value))
        state.close()
        if state.header is None:
            return
        for message, usage in zip(state.messages, state.usages, strict=False):
            message["usage"] = usage
        yield {**state.header, "model": state.model}
        yield from state.events

    def normalize(self, tool: str, arguments: Any) -> str:
        a = record(arguments)
        if tool in ("exec_command", "shell"):
            words = next((a[k] for k in ("cmd", "command") if isinstance(a.get(k), str)), None)
            if words is None:
                words = " ".join(string(x) if x is not None else "" for x in a["command"]) if isinstance(a.get("command"), list) else ""
            return command_kind(words)
        if tool == "apply_patch":
            patch = next((a[k] for k in ("input", "raw") if isinstance(a.get(k), str)), "")
            return "file_write" if "*** Add File:" in patch else "file_edit"
        if tool == "web_search":
            return "web_fetch" if a.get("type") == "open_page" else "web_search"
        return tool
