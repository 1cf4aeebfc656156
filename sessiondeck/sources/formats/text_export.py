"""Transcripts as the terminal shows them: a lossy source, for when the log itself can't be had.

Lines are gathered in blocks that begin with a mark: a user's text, the assistant's text or call, a result, a collapsed
call, a recap or a timing. Tokens, thinking, call ids, exit codes and all times but the file name's are not there.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from typing import Any

from ...schema import FORMAT_VERSION
from .base import Event, Format, Layout, home

WRAP = 68
NBSP = " "
#: What begins a block; the first that fits.
MARKS = (
    ("user", re.compile(r"❯")),
    ("assistant", re.compile(r"⏺")),
    ("timing", re.compile(r"✻ ")),
    ("recap", re.compile(r"※ ")),
    ("result", re.compile(r" {2}⎿")),
    ("collapsed", re.compile(r" {2}(Read|Searched|Listed|Wrote|Recalled|Fetch|Fetched|Updated|Created|Found|Crafted|Search)\b.*\(ctrl\+o to expand\)\s*\Z")),
)
#: Labels of calls besides single words in camel case.
LABELS = {
    "bash", "read", "write", "edit", "update", "multiedit", "glob", "grep", "search", "task", "fetch", "webfetch", "websearch",
    "web search", "agent", "notebookedit", "todowrite", "bashoutput", "killshell",
}
#: The argument that a label's text stands for.
ARGUMENTS = {"bash": "command", "read": "file_path", "update": "file_path", "edit": "file_path", "write": "file_path", "fetch": "url", "webfetch": "url", "websearch": "query", "web search": "query"}
#: Labels in lower case and what they are called.
TOOL_NAMES = {
    "bash": "terminal", "read": "file_read", "update": "file_edit", "edit": "file_edit", "multiedit": "file_edit", "write": "file_write", "grep": "content_search",
    "glob": "file_search", "search": "file_search", "fetch": "web_fetch", "webfetch": "web_fetch", "task": "sub_agent", "agent": "sub_agent",
}
#: The note on what an export lacks, and the mark of a text that was cut.
FIDELITY = "Parsed from a Claude Code /export transcript (display text). Lossy: no token usage, no thinking, no real tool-call ids, tool payloads may be truncated, prose newlines are approximate."
CLIPPED = "…[truncated]"
#: Patterns of what the terminal shows. Hints that there is more, and lines that are left out; failures; a call and a tool's name; branches of the agents' tree and their results; the banner's art, program, separator and folder; a file's name.
EXPAND_HINT, MORE_LINES = re.compile(r"\s*\(ctrl\+o to expand\)\s*"), re.compile(r"…\s*\+\d+ lines.*")
FAILED = re.compile(r"\b(error|fail(ed|ure|s)?|forbidden|not found|denied|exit code [1-9])\b", re.I)
CALL, TOOL_NAME = re.compile(r"([A-Z][A-Za-z0-9]*(?: [A-Z][A-Za-z0-9]*)*)\((.*)\Z"), re.compile(r"[A-Z][a-z]+([A-Z][a-z]+)*")
BRANCH, LEAF = re.compile(r"[├└]\s*(.+?)(?:\s+·\s+(.*))?\Z"), re.compile(r"⎿\s*(.*)\Z")
ART, PROGRAM, SEPARATOR, FOLDER = " \t▐▛▜▝▘▎█", "Claude Code v", " · ", re.compile(r"~?/\S+")
FILE_NAME = re.compile(r"(\d{4}-\d{2}-\d{2})-(\d{2})(\d{2})(\d{2})-.+\Z")


def blocks(lines: list[str]) -> Iterator[tuple[str, list[str]]]:
    kind, held = "", []
    for line in lines:
        mark = next((name for name, rx in MARKS if rx.match(line)), None)
        if mark:
            if kind:
                yield kind, held
            kind, held = mark, [line]
        elif kind:
            held.append(line)
    if kind:
        yield kind, held


def unmarked(lines: list[str], mark: str) -> list[str]:
    return [re.sub(mark if not i else r"^ {0,2}", "", line, count=1) for i, line in enumerate(lines)]


def unwrap(lines: list[str]) -> str:
    """Lines that the terminal broke, joined: a line goes on if it is nearly full and the next is no list item."""
    out: list[str] = []
    goes_on = False
    for line in (x.rstrip() for x in lines):
        if goes_on and line and len(out[-1]) >= WRAP and not re.match(r"([-*·•]|[0-9]+\.)\s", line):
            out[-1] += f" {line}"
        else:
            out.append(line)
        goes_on = bool(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip()


def bullets(lines: list[str]) -> str:
    text = re.sub(r"\s+", " ", " ".join(line.rstrip() for line in lines))
    items = (re.sub(r"^[·•]\s*", "", x.strip()) for x in re.split(r"\s·\s", text))
    return "\n".join(f"· {x}" for x in items if x)


def without_box(text: str) -> str:
    """A plan without the frame around it."""
    kept: list[str] = []
    previous = None
    inner = [re.sub(r"\s*│\s*$", "", re.sub(r"^\s*│\s?", "", x)).rstrip() for x in text.split("\n") if not re.fullmatch(r"[\s│╭╮╰╯─]*", x)]
    for line in inner:
        if line or previous != "":
            kept.append(line)
        previous = line
    return "\n".join(kept).strip()


def without_clipping(text: str) -> str:
    """Without the terminal's hints that there is more; a last line says so instead."""
    shown = MORE_LINES.sub("", EXPAND_HINT.sub(" ", text))
    body = "\n".join(x for x in map(str.rstrip, shown.split("\n")) if x).strip()
    clipped = EXPAND_HINT.search(text) or MORE_LINES.search(text) or text.endswith("…")
    return f"{body}\n{CLIPPED}" if clipped else body


def looks_failed(content: str) -> bool:
    return FAILED.search(content.split("\n", 1)[0]) is not None


def tool_call(lines: list[str]) -> tuple[str, dict[str, Any]] | None:
    """Label and arguments of a call such as Name(text), which may run over lines."""
    if not (m := CALL.match(lines[0].removeprefix("⏺").removeprefix(" "))):
        return None
    label, told = m[1], " ".join([m[2], *map(str.strip, lines[1:])]).rstrip().removesuffix(")").rstrip()
    key = label.lower()
    if key not in LABELS and not TOOL_NAME.fullmatch(label):
        return None
    told = without_clipping(told.removesuffix("…").strip()).removesuffix(f"\n{CLIPPED}")
    return label, {ARGUMENTS.get(key, "input"): told}


def agents(lines: list[str]) -> list[tuple[dict[str, Any], str | None]]:
    """Arguments and result of each agent in the tree below a fan-out: a branch names one, and the first leaf below it is its result."""
    found: list[list] = []
    for line in map(str.strip, lines):
        branch, leaf = BRANCH.match(line), LEAF.search(line)
        if branch:
            about = {"description": branch[1], "meta": branch[2]}
            found.append([{k: v.strip() for k, v in about.items() if v is not None}, None])
        elif leaf and found and found[-1][1] is None:
            found[-1][1] = leaf[1].strip()
    return [tuple(x) for x in found]


def banner(lines: list[str]) -> tuple[str | None, str | None]:
    """Model and working folder: the first line with a separator says the one, the first with a path the other."""
    plain = [x for x in (line.lstrip(ART).strip() for line in lines) if x]
    at = next((i for i, x in enumerate(plain) if PROGRAM not in x and SEPARATOR in x), len(plain))
    folders = (FOLDER.search(x) for i, x in enumerate(plain) if i >= at or PROGRAM not in x)
    model = plain[at].split(SEPARATOR)[0].strip() if at < len(plain) else ""
    return model or None, next((m[0] for m in folders if m), None)


def file_name(name: str) -> tuple[str, str]:
    """Id and time."""
    base = name.removesuffix(".txt")
    m = FILE_NAME.match(base)
    return base, f"{m[1]}T{':'.join(m.groups()[1:])}" if m else ""


class TextExport(Format):
    name = "claude-export"
    layout = Layout(match=lambda name: name.endswith(".txt"), date_of=lambda name: m[0] if (m := re.match(r"\d{4}-\d{2}-\d{2}", name)) else None)

    def folder(self) -> str:
        return home(".sessiondeck", "exports")

    def detect(self, first: Any, text: str) -> bool:
        top = text[:4000]
        return first is None and bool(re.search(r"Claude Code v\d", top) or ("⏺" in top and "❯" in top))

    def normalize(self, tool: str, arguments: Any) -> str:
        n = tool.strip().lower()
        if n in TOOL_NAMES:
            return TOOL_NAMES[n]
        if n.startswith("search"):
            return "file_search"
        if n in ("websearch", "web search"):
            return "web_search"
        return "sub_agent" if "agent" in n else tool

    def parse(self, text: str, path: str) -> Iterator[Event]:
        lines = text.replace(NBSP, " ").split("\n")
        body = next((i for i, line in enumerate(lines) if re.match(r"[❯⏺✻※]", line)), 0)
        model, cwd = banner(lines[:body])
        own, at = file_name(os.path.basename(path))
        yield {"type": "session_start", "formatVersion": FORMAT_VERSION, "path": path, "agent": "claude-code", "id": own, "timestamp": at, "cwd": cwd or "", "model": model}
        parent = own
        made = [{"type": "custom_message", "customType": "export_fidelity", "content": FIDELITY, "timestamp": at}, *self._body(blocks(lines[body:]), model or "")]
        for i, event in enumerate(made, 1):
            yield {"timestamp": "", **event, "id": f"e{i}", "parentId": parent}
            parent = f"e{i}"

    def _body(self, found: Iterator[tuple[str, list[str]]], model: str) -> Iterator[Event]:
        said = {"type": "assistant_message", "text": "", "toolCalls": [], "provider": "anthropic", "model": model}
        calls = 0
        awaits: str | None = None  # what a result would belong to: a call's id, `answers`, or nothing
        for kind, lines in found:
            due, awaits = awaits, None
            match kind:
                case "user":
                    if t := unwrap(unmarked(lines, r"^❯ ?")):
                        yield {"type": "user_message", "text": t}
                case "recap":
                    yield custom("recap", re.sub(r"^recap:\s*", "", unwrap(unmarked(lines, r"^※ ?"))))
                case "collapsed":
                    yield custom("collapsed_tools", without_clipping(" ".join(lines).strip()))
                case "assistant":
                    top = re.sub(r"^⏺ ?", "", lines[0])
                    if re.match(r"\d+\s+.*\bagents?\b.*\bfinished", top, re.I):
                        tree = [(f"t{calls + i}", a, r) for i, (a, r) in enumerate(agents(lines[1:]), 1)]
                        calls += len(tree)
                        yield {**said, "toolCalls": [{"id": own, "name": "Task", "arguments": a} for own, a, _ in tree]}
                        for own, _, r in tree:
                            if r is not None:
                                yield {"type": "tool_result", "toolCallId": own, "toolName": "Task", "content": r, "isError": looks_failed(r)}
                    elif re.match(r"User (answered|declined)", top, re.I):
                        awaits = "answers"
                    elif call := tool_call(lines):
                        calls += 1
                        awaits = f"t{calls}"
                        yield {**said, "toolCalls": [{"id": awaits, "name": call[0], "arguments": call[1]}]}
                    else:
                        yield {**said, "text": unwrap(unmarked(lines, r"^⏺ ?"))}
                case "result":
                    raw = unmarked(lines, r"^ {0,2}⎿ {0,2}")
                    whole = "\n".join(raw)
                    if "Claude's plan" in whole or "╭" in whole:
                        yield custom("plan", without_box(whole))
                    elif due == "answers":
                        yield custom("user_answers", without_clipping(bullets(raw)))
                    else:
                        content = without_clipping("\n".join(re.sub(r"^\s*\d+\s([+\- ])", r"\1", x) for x in raw).strip())
                        yield {"type": "tool_result", "toolCallId": due, "toolName": "", "content": content, "isError": looks_failed(content)} if due else custom("output", content)


def custom(kind: str, content: str) -> Event:
    return {"type": "custom_message", "customType": kind, "content": content}
