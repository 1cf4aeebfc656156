"""What errors, messages, calls and commands are, by the first rule that fits."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..sources.formats.claude_jsonl import NOISE_COMMAND_CHARS, NOISE_PARTS, NOISE_PREFIXES
from ..sources.formats.codex_rollout import COMMANDS, INJECTED
from .text import col, one_line, spaced, strip_ansi, trimmed

#: Patterns in an error's text, on one line, and the error's name.
ERRORS = (
    (r"File has not been read yet", "write-before-read"),
    (r"File has been modified since read", "stale-read"),
    (r"File does not exist", "file-not-found"),
    (r"temporarily unavailable, so auto mode cannot determine the safety", "model-unavailable (auto-approve blocked)"),
    (r"paths are ignored by one of your \.gitignore|FAILED: git add", "git-add-ignored-path"),
    (r"No staged files match any configured task", "precommit-hook (lint-staged)"),
    (r"cannot access .* No such file or directory", "path-not-found"),
    (r"Too many arguments", "bad-tool-args"),
    (r"FAILED\b|Tests\\\\|⨯", "test-failure"),
    (r"[0-9]+ matches for|^0 matches", "grep-no-match"),
    (r"<tool_use_error>", "tool-use-error"),
)
#: Patterns in a user's message, in any case, and its intent.
INTENTS = (
    (r"why (?:does|is) (?:it|this) (?:take|taking|so)|still (?:not|broken|failing)|come on|seriously|how many times|[?!]{2,}", "FRUSTRATION"),
    (r"i'?d challenge|i would challenge|why (?:are|did|would|does|is|the)|why dropping|disagree|push ?back|that'?s wrong|are you sure|reconsider|instead of", "CHALLENGE"),
    (r"did you (?:load|check|read|run|confirm)|i (?:originally |already )?asked|never saw|you (?:didn'?t|forgot|missed|skipped)|should(?:n'?t)? have|undo|revert|that'?s not", "CORRECTION"),
    (r"proceed|go ahead|commit|lgtm|looks good|happy to|sounds good|continue|ship it|approved?|alright", "APPROVAL"),
)


def _first(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for hit, value in reversed(rules):
        out = F.when(hit, value).otherwise(out)
    return out


def error_name(content: str | Column, exit_code: str | Column | None = None) -> Column:
    c = strip_ansi(spaced(content))
    code = F.regexp_extract(c, r"^Exit code ([0-9]+)", 1)
    rules = [(c.rlike(rx), F.lit(name)) for rx, name in ERRORS] + [(code != "", F.concat(F.lit("bash-exit-"), code))]
    if exit_code is not None:
        n = col(exit_code)
        rules.append((F.coalesce(n != 0, F.lit(False)), F.concat(F.lit("bash-exit-"), n.cast("string"))))
    return _first(rules, F.lit("error"))


def user_intent(text: str | Column) -> Column:
    """struct<intent, text>: of a command, its arguments as the text."""
    t = col(text)
    arguments = r"(?s)<command-args>(.*?)</command-args>"
    rules = [(t.rlike(f"(?i){rx}"), F.lit(name)) for rx, name in INTENTS]
    other = F.when(trimmed(t).endswith("?"), F.lit("QUESTION")).otherwise(F.lit("INSTRUCTION"))
    intent = _first([(t.rlike(arguments), F.lit("COMMAND")), (t.startswith("<command"), F.lit("COMMAND")), *rules], other)
    return F.when(t.isNotNull(), F.struct(intent.alias("intent"), one_line(F.when(t.rlike(arguments), F.regexp_extract(t, arguments, 1)).otherwise(t), 200).alias("text")))


def command_kind(command: str | Column) -> Column:
    c = trimmed(command)
    return _first([(c.rlike(rf"(?U)^{rx}"), F.lit(kind)) for rx, kind in COMMANDS], F.lit("terminal"))


def is_noise(text: str | Column) -> Column:
    """Whether a text in the user's name is the agent's own."""
    t = trimmed(text)
    bare = F.length(trimmed(F.regexp_replace(t, r"<[^>]+>", "")))
    hits = [t == "", *[t.startswith(p) for p in NOISE_PREFIXES], *[t.contains(p) for p in NOISE_PARTS], t.startswith("<command-") & (bare < NOISE_COMMAND_CHARS)]
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def without_injected(text: str | Column) -> Column:
    """Empty if it is a text that the agent puts before the user's."""
    t = trimmed(text)
    hit = t.startswith(INJECTED[0])
    for p in INJECTED[1:]:
        hit = hit | t.startswith(p)
    return F.when(hit, F.lit("")).otherwise(col(text))


def argument(arguments: str | Column, *keys: str) -> Column:
    """The first of the keys whose value is a string, from an object as JSON."""
    v = F.try_parse_json(col(arguments))
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.try_variant_get(v, f"$.{k}", "string")) for k in keys])


def primary_argument(arguments: str | Column, strip: dict[str, str] | None = None) -> Column:
    """What a call is about: a command, a path (with parts replaced), a pattern and where, or another text."""

    def relative(x: Column) -> Column:
        for old, new in (strip or {}).items():
            x = F.replace(x, F.lit(old), F.lit(new))
        return x

    a = col(arguments)
    path = argument(a, "path")
    pattern = argument(a, "pattern")
    anything = F.regexp_extract(a, r'(?s)^\{(?:"(?:[^"\\]|\\.)*":(?:[^"{\[][^,}]*),)*"(?:[^"\\]|\\.)*":"((?:[^"\\]|\\.)*)"', 1)
    return F.coalesce(
        argument(a, "command", "cmd"), relative(argument(a, "file_path", "path", "notebook_path")),
        F.when(path.isNull(), pattern).otherwise(F.concat(pattern, F.lit("  (in "), relative(path), F.lit(")"))),
        argument(a, "query", "url", "prompt", "description"), anything, F.lit(""),
    )


def command_of(arguments: str | Column) -> Column:
    """A call's command: a string, or a list's strings joined."""
    v = F.try_parse_json(col(arguments))
    listed = F.coalesce(F.try_variant_get(v, "$.command", "array<variant>"), F.try_variant_get(v, "$.cmd", "array<variant>"))
    words = F.transform(F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(argument(arguments, "command", "cmd"), F.nullif(F.array_join(words, " "), F.lit("")))


def mentions(text: str | Column, parts: list[str], prefix: str | None = None) -> Column:
    """Whether a text holds one of the parts, or begins with the prefix, in any case."""
    low = F.lower(col(text))
    out = low.startswith(prefix.lower()) if prefix else F.lit(False)
    for p in parts:
        out = out | low.contains(p.lower())
    return F.coalesce(out, F.lit(False))
