"""JSON values in a row, one to a line or printed over many, as agents append them to their logs.

A value that is cut off at the end of the text, but valid so far, is still being written and is left out. Anything else that
isn't JSON is an error that names file and line, raised after the values before it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import Any, TextIO

_SPACE = re.compile(r"[ \t\r\n]*")
_TOKEN = re.compile(
    r'(?P<string>"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*")'
    r"|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
    r"|(?P<word>true|false|null)|(?P<mark>[{}\[\]:,])"
)
#: What a token may look like when the text ends within it.
_CUT = re.compile(
    r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*(?:\\(?:u[0-9a-fA-F]{0,3})?)?\Z'
    r"|-?(?:(?:0|[1-9][0-9]*)(?:\.[0-9]*|(?:\.[0-9]+)?[eE][+-]?)?)?\Z"
    r"|t(?:r(?:ue?)?)?\Z|f(?:a(?:l(?:se?)?)?)?\Z|n(?:u(?:ll?)?)?\Z"
)


class MalformedRecord(ValueError):
    pass


def _no_constant(name: str) -> Any:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_constant=_no_constant)


def first_fault(text: str, at: int) -> int | None:
    """Where the value that begins at `at` stops being JSON; None if the text ends before that."""
    stack: list[str] = []
    wants = {"value"}
    while True:
        at = _SPACE.match(text, at).end()
        if at == len(text):
            return None
        if _CUT.match(text, at) and ("value" in wants or (text[at] == '"' and "key" in wants)):
            return None
        m = _TOKEN.match(text, at)
        if m is None:
            return _fault_in(text, at, wants)
        token = m[0]
        if m.lastgroup != "mark" and "value" in wants or token in "{[" and m.lastgroup == "mark" and "value" in wants:
            if token in ("{", "["):
                stack.append(token)
                wants = {"key", "}"} if token == "{" else {"value", "]"}
            else:
                wants = _after(stack)
        elif m.lastgroup == "string" and "key" in wants:
            wants = {":"}
        elif token in wants:
            if token == ":":
                wants = {"value"}
            elif token == ",":
                wants = {"key"} if stack[-1] == "{" else {"value"}
            else:
                stack.pop()
                wants = _after(stack)
        else:
            return at
        at = m.end()
        if not wants:
            return at


def _after(stack: list[str]) -> set[str]:
    """What may follow a finished value."""
    return {",", "}" if stack[-1] == "{" else "]"} if stack else set()


def _fault_in(text: str, at: int, wants: set[str]) -> int:
    """Within a token that is neither whole nor cut off: its first character that can't be."""
    if text[at] == '"' and wants & {"value", "key"}:
        good = re.compile(r'"(?:[^"\\\x00-\x1f]|\\["\\/bfnrt]|\\u[0-9a-fA-F]{4})*').match(text, at)
        return good.end() if good else at
    return at


def json_values(text: str | Iterable[str], name: str = "input", line: int = 1) -> Iterator[Any]:
    """The values of a text, or of one that comes in parts, of which no more is held than one value and a part. line: the number of its first one."""
    if not isinstance(text, str):
        yield from _of_parts(text, name)
        return
    at = 0
    while (at := _SPACE.match(text, at).end()) < len(text):
        try:
            value, end = _DECODER.raw_decode(text, at)
            glued = isinstance(value, (int, float)) and not isinstance(value, bool) and end < len(text) and text[end] not in " \t\r\n,]}"
            if glued:
                raise ValueError("a number runs on")
        except ValueError:
            fault = first_fault(text, at)
            if fault is None:
                return
            raise MalformedRecord(f"{name}:{text.count(chr(10), 0, fault) + line}: malformed JSON record") from None
        yield value
        at = end


def _of_parts(parts: Iterable[str], name: str) -> Iterator[Any]:
    """A value counts as whole when something follows it. After one that goes on, twice as much is gathered before the next try, so that all tries together stay linear."""
    held, line, wanted = "", 1, 0
    for part in parts:
        held += part
        if len(held) < wanted:
            continue
        at = 0
        while (at := _SPACE.match(held, at).end()) < len(held):
            try:
                value, end = _DECODER.raw_decode(held, at)
            except ValueError:
                if first_fault(held, at) is not None:
                    break  # json_values() below says where
                wanted = 2 * (len(held) - at)
                break
            if end == len(held) or (isinstance(value, (int, float)) and held[end] not in " \t\r\n"):
                break
            yield value
            at, wanted = end, 0
        line += held.count("\n", 0, at)
        held = held[at:]
        if not wanted and held and first_fault(held, 0) is not None and _is_broken(held):
            break
    yield from json_values(held, name, line)


def _is_broken(text: str) -> bool:
    try:
        _DECODER.raw_decode(text)
    except ValueError:
        return True
    return False


def first_json_value(text: str) -> Any:
    """The first value, or None if there is none or it isn't JSON."""
    try:
        return next(json_values(text), None)
    except MalformedRecord:
        return None


def read_first_value(f: TextIO, step: int = 1 << 16) -> Any:
    """The first value of a text file, read only as far as it goes."""
    text = ""
    while part := f.read(max(step, len(text))):  # twice as far each time, so that all attempts together stay linear
        text += part
        try:
            for value in json_values(text):
                if not isinstance(value, (int, float)) or text[-1] in " \t\r\n" or len(text) > len(json.dumps(value)) + 8:
                    return value
                break  # a number may go on
        except MalformedRecord:
            return None
    return first_json_value(text)


def first_lines(text: str, n: int) -> list[str]:
    """The first n lines that aren't blank."""
    found = (line for line in re.split(r"\r?\n", text) if line.strip())
    return [line for _, line in zip(range(n), found, strict=False)]


def lenient_lines(text: str) -> Iterator[Any]:
    """Each line's value; lines that aren't JSON are left out."""
    for line in text.splitlines():
        if line.strip():
            try:
                yield json.loads(line)
            except ValueError:
                continue
