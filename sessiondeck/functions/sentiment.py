"""How frustrated a user's message is, by patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col

#: Signal, weight, pattern. All but `caps` match in any case; ^ and $ are those of a line.
SIGNALS = (
    ("bare-no", 0.4, r"^no\.?!?$"),
    ("bare-wrong", 0.5, r"^wrong\.?!?$"),
    ("bare-stop", 0.6, r"^stop\.?!?$"),
    ("stop-doing", 0.6, r"\bstop\b.*(changing|doing|modifying|touching|removing|deleting)"),
    ("thats-not-right", 0.5, r"that'?s not (what|right|correct)"),
    ("thats-wrong", 0.5, r"that'?s wrong"),
    ("not-what-i-asked", 0.6, r"not what I (asked|said|meant|wanted)"),
    ("already-said", 0.6, r"I (already|just) (said|told|asked|mentioned)"),
    ("i-said", 0.4, r"I said\b"),
    ("as-i-said", 0.5, r"as I (said|mentioned|told)"),
    ("again", 0.3, r"again[.!]?$"),
    ("you-keep", 0.6, r"you keep"),
    ("why-did-you", 0.5, r"why did you"),
    ("you-broke", 0.7, r"you (broke|ruined|messed|screwed)"),
    ("youre-not", 0.5, r"you('re| are) (not|ignoring|missing)"),
    ("dont-do-that", 0.5, r"don'?t (do that|change|touch|modify|remove|delete)"),
    ("just-do-it", 0.4, r"just do (it|what)"),
    ("please-just", 0.3, r"please just"),
    ("can-you-just", 0.2, r"can you (just|please)"),
    ("try-again", 0.3, r"try again"),
    ("revert", 0.3, r"revert"),
    ("undo", 0.3, r"undo"),
    ("caps", 0.3, r"[A-Z]{5,}"),
    ("exclamation", 0.3, r"!{2,}"),
    ("question-marks", 0.3, r"\?{2,}"),
)
CASED = ("caps",)
#: A short reply to a long message adds to other signals.
BRIEF, BRIEF_WEIGHT, BRIEF_BELOW, LONG_ABOVE = "brief-correction", 0.2, 20, 200


def _java(name: str, pattern: str) -> str:
    """Lines end at the four terminators that the patterns' first home knows, and a word is ASCII."""
    ends = r"(?=[\n\r\x{2028}\x{2029}]|\z)"
    begins = r"(?<=[\n\r\x{2028}\x{2029}]|\A)"
    p = (begins + pattern[1:]) if pattern.startswith("^") else pattern
    p = p[:-1] + ends if p.endswith("$") else p
    return p if name in CASED else f"(?i){p}"


def frustration(text: str | Column, previous_length: str | Column | None = None) -> Column:
    """struct<score, signals>: the sum of the signals' weights, 1 at most."""
    t = col(text)
    found = [(name, weight, t.rlike(_java(name, pattern))) for name, weight, pattern in SIGNALS]
    some = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, _, hit in found]))
    total = sum((F.when(hit, F.lit(weight)).otherwise(F.lit(0.0)) for _, weight, hit in found), F.lit(0.0))
    if previous_length is not None:
        brief = F.coalesce((col(previous_length) > LONG_ABOVE) & (F.length(t) < BRIEF_BELOW), F.lit(False)) & (F.size(some) > 0)
        some = F.when(brief, F.concat(some, F.array(F.lit(BRIEF)))).otherwise(some)
        total = total + F.when(brief, F.lit(BRIEF_WEIGHT)).otherwise(F.lit(0.0))
    return F.when(t.isNotNull(), F.struct(F.round(F.least(F.lit(1.0), total), 6).alias("score"), some.alias("signals")))
