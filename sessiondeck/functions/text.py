"""Text helpers. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SPACE = r"(?U)\s"


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(text: str | Column) -> Column:
    """Without space of any kind at both ends."""
    return F.regexp_replace(col(text), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+\z", "")


def blank(text: str | Column) -> Column:
    return trimmed(text) == ""


def truncate(text: str | Column, n: int = 300) -> Column:
    """The first n characters and `...` if there are more."""
    t = col(text)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n), F.lit("...")))


def truncate_line(text: str | Column, n: int = 120) -> Column:
    """On one line, trimmed, then truncated."""
    return truncate(trimmed(F.replace(col(text), F.lit("\n"), F.lit(" "))), n)


def strip_ansi(text: str | Column) -> Column:
    """Without the codes that colour a terminal's text."""
    return F.regexp_replace(col(text), "\x1b\\[[0-9;]*m", "")


def spaced(text: str | Column) -> Column:
    """Each run of space of any kind as one space."""
    return F.regexp_replace(col(text), r"(?U)[\s\x{FEFF}]+", " ")


def one_line(text: str | Column, n: int = 140) -> Column:
    """Spaced, and cut with an ellipsis."""
    t = spaced(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def first_lines(text: str | Column, n: int) -> Column:
    """The first n lines; none for n below 1."""
    return F.substring_index(col(text), "\n", n) if n > 0 else F.when(col(text).isNotNull(), F.lit(""))


def quoted(text: str | Column) -> Column:
    """Each line after `> `."""
    return F.concat(F.lit("> "), F.replace(col(text), F.lit("\n"), F.lit("\n> ")))


def plain_spaces(text: str | Column) -> Column:
    return F.translate(col(text), " ", " ")


def thousands(n: str | Column, digits: int = 0) -> Column:
    """With commas between thousands, rounded half up."""
    return F.format_number(F.round(col(n).cast("double"), digits), digits)


def first_filled_line(text: str | Column, default: str = "unknown") -> Column:
    return F.coalesce(F.get(F.filter(F.split(col(text), "\n", -1), lambda x: trimmed(x) != ""), F.lit(0)), F.lit(default))
