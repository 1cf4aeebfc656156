"""Benchmark decontamination by question templates.

Texts become tokens (runs of letters and digits, lower-cased), in which numbers, units and names are typed placeholders:
a number starts with a digit (groups joined by a point, comma or colon are one) or is one of NUMBERS (a run of these, or
after digits, is one); a unit is one of UNITS right after a number; a name is a capitalised word, not all capitals, of any
script that has capitals (a run of them is one). There are two templates: in the first a name must follow a word in the same
clause, so that the words that begin sentences stay literal; in the second it may stand anywhere, so that names that begin
a sentence, a line or a quote are slots too, and so are all other words there. A third form are the bare words, without
placeholders, so that a copy in capitals, in which no name shows, is found too.

Windows of `WINDOW` tokens of each form are hashed, with the fillers of their slots. The documents are read once: a window goes on
only if its hash is in a bitmap of the benchmark's (of `2**MAX_BITS` bits at most; where it is full more windows go on, and
nothing is lost). These are joined to the benchmark's windows by hash. An item is found in a text if at least
`SIMILARITY` of its windows of one form are there. Then its slots are checked
where the windows align. Names that were changed must agree: equal names stand for equal names and different for different,
in `SIMILARITY` of their slots at least, else the find is dropped. Numbers and units are values, which may coincide or vary.
The find is `verbatim` if all fillers are the item's own; `reparameterised` if equal fillers always stand for equal ones; and
`altered` if some do not, as in a copy with one number mistyped. What the bare words find is `verbatim`.

Texts are known by a 64-bit hash: equal texts of one doc_id are judged once, and reported each.

Defined cases: an item of fewer tokens than a window is one window of all its tokens; windows of placeholders only say
nothing and aren't used, and an item that has no others is found by its bare words alone; an item or document that is
null or without tokens is never found; equal items are all reported; a document's other columns don't matter; rows that
repeat are reported each.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common, vec

WINDOW, SIMILARITY = 5, 0.8
#: Of the bitmap: 32 MB at most.
MIN_BITS, MAX_BITS = 24, 28
#: The benchmark's windows, and the hashes of texts that go, are broadcast while there are at most so many; else joined by shuffle.
BROADCAST_WINDOWS, BROADCAST_TEXTS = 200_000, 1_000_000
UNITS = "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg lb lbs pound pounds ounce ounces oz ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur gbp meter meters metre metres gram grams kilogram kilograms kilometer kilometers centimeter centimeters degree degrees celsius fahrenheit mph kmh watt watts volt volts joule joules newton newtons hz".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
LITERAL, NUMBER, UNIT, NAME = range(4)
TEMPLATE, ANYWHERE, BARE = range(3)  # forms of a text
KINDS = "verbatim", "reparameterised", "altered"
_PLACE = np.array([0, 0x51, 0x52, 0x53], np.uint64)


class Form(NamedTuple):
    code: np.ndarray  # hash of a literal, or of its placeholder
    kind: np.ndarray
    filler: np.ndarray  # hash of the token's own text
    owner: np.ndarray


@lru_cache(maxsize=1)
def _cases() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a capital, and whether it is a small letter."""
    return tuple(np.fromiter((f(chr(i)) for i in range(0x110000)), bool, 0x110000) for f in (lambda x: x.isupper() or x.istitle(), str.islower))


def points(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points that begin at these bytes, and where the next ones do; beyond the end, NUL."""
    get = lambda k: np.where(at + k < len(data), data[np.minimum(at + k, len(data) - 1)], 0).astype(np.int64)
    a, b, c, d = (get(k) for k in range(4))
    long = 1 + (a >= 0xC0) + (a >= 0xE0) + (a >= 0xF0)
    b, c, d = b & 63, c & 63, d & 63
    point = np.select([long == 1, long == 2, long == 3], [a, (a & 31) << 6 | b, (a & 15) << 12 | b << 6 | c], (a & 7) << 18 | b << 12 | c << 6 | d)
    return np.minimum(point, 0x10FFFF), at + long


def tokens(texts: pa.Array) -> list[Form]:
    """The texts' two templates, and their bare words."""
    data, offsets = vec.buffers(texts, lower=False)
    starts, ends = vec.spans(data, offsets, vec.WORD)
    n = len(starts)
    if not n:
        return [Form(*(np.zeros(0, kind) for kind in (np.uint64, np.int64, np.uint64, np.int64)))] * 3
    owner = vec.owners(offsets, starts)
    follows = np.zeros(n, bool)
    follows[1:] = owner[1:] == owner[:-1]
    gap = np.zeros(n, np.int64)
    gap[1:] = starts[1:] - ends[:-1]
    after = lambda x: np.concatenate([[False], x[:-1]])  # noqa: E731  whether the token before is so
    first, before = data[starts], data[np.maximum(starts - 1, 0)]
    digit = (first >= 0x30) & (first <= 0x39)
    glued = follows & digit & after((data[ends - 1] >= 0x30) & (data[ends - 1] <= 0x39)) & after(digit) & (gap == 1) & np.isin(before, [0x2C, 0x2E, 0x3A])
    capital, small = _cases()
    point, next_at = points(data, starts)
    named = capital[point] & (next_at < ends) & small[points(data, next_at)[0]]
    plain_gap = follows & (gap >= 1) & (gap <= 2) & (before == 0x20) & ((gap == 1) | (data[np.maximum(starts - 2, 0)] == 0x2C))
    lowered, low_offsets = vec.buffers(pa.array([(x or "").lower() for x in texts.to_pylist()], pa.large_string()), lower=False)
    low_starts, low_ends = vec.spans(lowered, low_offsets, vec.WORD)
    if len(low_starts) != n:  # lower-casing has made or unmade a word; none is known to
        lowered, low_starts, low_ends = vec.LOWER[data], starts, ends
    word = vec.hashes(lowered, low_starts, low_ends)
    spelt = np.isin(word, vec.hash_of(NUMBERS))
    number = digit | spelt
    glued |= follows & spelt & after(number) & (gap == 1) & np.isin(before, [0x20, 0x2D])
    unit = follows & np.isin(word, vec.hash_of(UNITS)) & after(number) & ~number & (gap <= 1)
    named &= ~unit & ~number

    def form(name: np.ndarray) -> Form:
        run = name & follows & after(name) & (gap == 1) & (before == 0x20)
        keep = ~(glued | run)
        kind = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, LITERAL)))[keep]
        last = np.concatenate([np.flatnonzero(keep)[1:], [n]]) - 1  # a filler runs to the end of what was joined to it
        filler = np.where(last == np.flatnonzero(keep), word[keep], 0).astype(np.uint64)
        joined = np.flatnonzero(last != np.flatnonzero(keep))
        if len(joined):
            filler[joined] = vec.hashes(lowered, low_starts[keep][joined], low_ends[last[joined]])
        return Form(np.where(kind == LITERAL, filler, vec.mix(_PLACE[kind])), kind, filler, owner[keep])

    return [form(named & plain_gap), form(named), Form(word, np.zeros(n, np.int64), word, owner)]


def windows(code: np.ndarray, kind: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows within one text that hold a literal."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, literal = np.zeros(n, np.uint64), np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = (h ^ code[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            literal |= kind[j : j + n] == LITERAL
    at = np.flatnonzero(literal & (owner[:n] == owner[size - 1 :]))
    return at, h[at]


def window_slots(t: Form, at: np.ndarray, size: int) -> list[list[int]]:
    """Of each window that begins at these tokens: offset and kind (as one number) and filler of its slots, in turn."""
    if not len(at):
        return []
    kind = np.stack([t.kind[at + j] for j in range(size)], 1)
    out: list[list[int]] = [[]] * len(at)
    for i in np.flatnonzero(kind.any(1)):
        own = [(j * 4 + int(kind[i, j]), int(t.filler[at[i] + j].view(np.int64))) for j in np.flatnonzero(kind[i])]
        out[i] = [x for pair in own for x in pair]
    return out


def judge(slots: dict[int, tuple[int, int, int]], similarity: float) -> int | None:
    """The place in KINDS of a find, or None if its names don't agree. slots: kind, own and other filler by the item's token."""
    there, back = defaultdict(Counter), defaultdict(Counter)
    for what, own, other in slots.values():
        there[what, own][other] += 1
        back[what, other][own] += 1
    if all(own == other for _, own, other in slots.values()):
        return 0
    most = lambda counts: max(counts, key=lambda x: (counts[x], x))
    usual, origin = {k: most(c) for k, c in there.items()}, {k: most(c) for k, c in back.items()}
    names = [(own, other) for what, own, other in slots.values() if what == NAME and there[what, own].keys() != {own}]
    agree = sum(usual[NAME, own] == other and origin[NAME, other] == own for own, other in names)
    if agree < similarity * len(names):
        return None
    return 1 if agree == len(names) and all(len(c) == 1 for c in there.values()) else 2


def judge_find(own: np.ndarray, at: np.ndarray, own_slots: list, slots: list, similarity: float) -> int | None:
    """Of one item in one text: the best judgement over the shifts (position in the text less that in the item) of most windows."""
    shifts, votes = np.unique(at - own, return_counts=True)
    told = []
    for shift in shifts[votes == votes.max()]:
        aligned = {}
        for i in np.flatnonzero(at - own == shift):
            x, y = own_slots[i], slots[i]
            for j in range(0, min(len(x), len(y)), 2):
                aligned[int(own[i]) + int(x[j]) // 4] = int(x[j]) % 4, int(x[j + 1]), int(y[j + 1])
        told.append(judge(aligned, similarity))
    return min((x for x in told if x is not None), default=None)


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """form, size, hash, own (position), own_slots and n_windows of each distinct item's windows, with item_id, item (a hash of its text) and copies."""
    items = benchmark.where(F.col(text).isNotNull()).groupBy(F.col(item_id).alias("item_id"), F.col(text).alias("text")).agg(F.count("*").alias("copies"))
    items = items.select("item_id", F.xxhash64("text").alias("item"), "copies", "text")
    schema = T.StructType([items.schema["item_id"], *T.StructType.fromDDL("item long, copies long, form int, size int, hash long, own int, own_slots array<long>, n_windows int").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch):
                for f, t in enumerate(tokens(part.column("text"))):
                    begin = vec.bounds(t.owner, part.num_rows)
                    for size in range(1, window + 1):  # an item shorter than a window is one of its own size
                        p, h = windows(t.code, t.kind, t.owner, size)
                        long = np.diff(begin)[t.owner[p]]
                        some = np.flatnonzero(long == size if size < window else long >= size)
                        p, h = p[some], h[some]
                        if not len(p):
                            continue
                        of = t.owner[p]
                        n = np.bincount(of, minlength=part.num_rows)[of]
                        fixed = [pa.array(np.full(len(p), x), pa.int32()) for x in (f, size)]
                        yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(of)) for c in ("item_id", "item", "copies")), *fixed, pa.array(h.view(np.int64)), pa.array(p - begin[of], pa.int32()), pa.array(window_slots(t, p, size), pa.list_(pa.int64())), pa.array(n, pa.int32())], schema.names)

    return items.mapInArrow(each, schema)


def bitmap(known: DataFrame, n: int) -> np.ndarray:
    """Two bits for each window's hash, by its first bits and by those that follow; combined in Spark, 64 to a row."""
    width = int(np.clip(np.ceil(np.log2(max(n, 1) * 32)), MIN_BITS, MAX_BITS))
    slots = [F.shiftrightunsigned("hash", 64 - k * width).bitwiseAND(F.lit((1 << width) - 1)) for k in (1, 2)]
    each = known.select(F.explode(F.array(*slots)).alias("slot"))
    rows = each.groupBy(F.shiftright("slot", 6).alias("k")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("slot") % 64).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(1 << (width - 6), np.uint64)
    out[rows["k"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def maybe_known(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of the hashes whose bits are both set."""
    width = len(bits).bit_length() - 1 + 6
    some = np.arange(len(h))
    for k in (1, 2):
        slot = h[some] >> np.uint64(64 - k * width) & np.uint64((1 << width) - 1)
        some = some[(bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return some


def finds(docs: DataFrame, benchmark: DataFrame, keys: list[str], similarity: float, window: int, text: str, item_id: str, shuffled: bool = False) -> DataFrame | None:
    """keys, text_hash, item_id, item_copies, text_copies, n_matched, similarity and kind (its place) of each item found in each distinct text; None if there are no windows."""
    spark = docs.sparkSession
    known = common.cut(benchmark_windows(benchmark, window, text, item_id))
    n, sizes = known.count(), [r["size"] for r in known.select("size").distinct().collect()]  # sizes: up to WINDOW
    if not n:
        return None
    sent = spark.sparkContext.broadcast(bitmap(known, n))
    rows = docs.where(F.col(text).isNotNull()).select(*keys, F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], *T.StructType.fromDDL("form int, size int, hash long, at int, slots array<long>").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch):
                for f, t in enumerate(tokens(part.column("text"))):
                    begin = vec.bounds(t.owner, part.num_rows)
                    for size in sizes:
                        p, h = windows(t.code, t.kind, t.owner, size)
                        some = maybe_known(sent.value, h)
                        if not len(some):
                            continue
                        p, h = p[some], h[some]
                        of = t.owner[p]
                        fixed = [pa.array(np.full(len(p), x), pa.int32()) for x in (f, size)]
                        yield pa.RecordBatch.from_arrays([*(c.take(pa.array(of)) for c in part.columns[:-1]), *fixed, pa.array(h.view(np.int64)), pa.array(p - begin[of], pa.int32()), pa.array(window_slots(t, p, size), pa.list_(pa.int64()))], schema.names)

    who = [*keys, "text_hash"]
    pair = [*who, "item_id", "item", "form"]
    hits = rows.mapInArrow(each, schema).join(F.broadcast(known) if n <= BROADCAST_WINDOWS and not shuffled else known, ["form", "size", "hash"])
    met = hits.groupBy(*pair, "n_windows", "own", "at").agg(F.count("*").alias("text_copies"), F.first("copies").alias("item_copies"), F.first("slots").alias("slots"), F.first("own_slots").alias("own_slots"))
    met = common.cut(met)  # what few texts share with the benchmark; the documents aren't read again
    # equal windows of an item count once each; what a text repeats doesn't count again
    counted = met.groupBy(*pair, "n_windows", "own").agg(F.max("text_copies").alias("text_copies"), F.max("item_copies").alias("item_copies"), F.bool_and(F.col("slots") == F.col("own_slots")).alias("alike"))
    counted = counted.groupBy(*pair, "n_windows").agg(F.max("item_copies").alias("item_copies"), F.max("text_copies").alias("text_copies"), F.count("*").alias("n_matched"), F.bool_and("alike").alias("alike"))
    enough = counted.where(F.col("n_matched") >= similarity * F.col("n_windows")).withColumn("similarity", F.col("n_matched") / F.col("n_windows"))
    enough = common.cut(enough)
    told = [*pair, "item_copies", "text_copies", "n_matched", "similarity"]
    plain = F.col("alike") | (F.col("form") == BARE)  # where all windows' fillers are the item's, they are so wherever these align
    judged_schema = T.StructType([*(enough.schema[c] for c in told), T.StructField("kind", T.IntegerType())])

    def each_find(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = judge_find(pdf["own"].to_numpy(), pdf["at"].to_numpy(), pdf["own_slots"].tolist(), pdf["slots"].tolist(), similarity)
        return pdf[told].head(int(kind is not None)).assign(kind=kind)

    left, same = enough.where(~plain).select(*told), F.lit(True)
    for c in pair:
        same = same & met[c].eqNullSafe(left[c])
    changed = left.join(met.select(*pair, "own", "at", "slots", "own_slots"), same).select(*[left[c] for c in told], "own", "at", "slots", "own_slots")
    judged = enough.where(plain).select(*told, F.lit(0).alias("kind")).unionByName(changed.groupBy(*pair).applyInPandas(each_find, judged_schema))
    best = F.min_by(F.struct("item_copies", "text_copies", "n_matched", "similarity", "kind"), F.struct("kind", "form"))
    return judged.groupBy(*who, "item_id", "item").agg(best.alias("best")).select(*who, "item_id", "best.*")


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", shuffled: bool = False) -> DataFrame:
    """doc_id, item_id, n_matched, similarity and kind (of `KINDS`) for each item found in a document."""
    found = finds(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias(text)), benchmark, ["doc_id"], similarity, window, text, item_id, shuffled)
    if found is None:
        schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType), *T.StructType.fromDDL("n_matched long, similarity double, kind string").fields])
        return docs.sparkSession.createDataFrame([], schema)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("item_copies") * F.col("text_copies")))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    return found.select("doc_id", "item_id", "n_matched", "similarity", kind.alias("kind"), each).drop("col")


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, window: int = WINDOW, text: str = "text", item_id: str = "item_id", shuffled: bool = False) -> DataFrame:
    """The rows of docs in which no item is found."""
    found = finds(docs.select(F.col(text).alias(text)), benchmark, [], similarity, window, text, item_id, shuffled)
    if found is None:
        return docs
    leak = "_leak"
    while leak in docs.columns:
        leak += "_"
    bad = common.cut(found.select(F.col("text_hash").alias(leak)).distinct())
    small = bad.count() <= BROADCAST_TEXTS and not shuffled
    return docs.join(F.broadcast(bad) if small else bad, F.xxhash64(docs[text]) == bad[leak], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
