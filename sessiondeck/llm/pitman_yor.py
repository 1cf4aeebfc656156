"""LM scoring with a hierarchical Pitman-Yor model.

Each token is served in the restaurant of its context, which is the token before it, or the beginning of the text: so there
is a restaurant for each distinct token of the corpus. All contexts' restaurants share one parent, the restaurant of all
tokens; tables of a context's restaurant are customers of the parent. The contexts have discount `DISCOUNT` and strength
`STRENGTH`. The parent has discount 0 and a base of `PLACE` for each place: one for each word of the training vocabulary and
one for all that isn't in it; with that discount its own tables integrate out, and its weights given its customers are
Dirichlet.

Seating is sampled by Gibbs, with two kinds of auxiliary variables that make all (context, word) pairs independent of each
other: a gamma variable g for each context, given its tables (it replaces the product of the strengths by g ** tables), and
the parent's weights, given its customers. Then the number of tables of a pair with n customers is t with odds
S(n, t) * a**t, where S are generalised Stirling numbers and a = DISCOUNT * g * the word's weight. With discount 1/2, S has a
closed form for any n, so each draw is exact (`draw_tables`), whatever the number of customers. A sweep draws all g and all
weights from the tables of the sweep before, and then all tables; nothing in it is approximate or out of date. A pair of one
customer always has one table and takes no part. Each variable's random numbers come from the hashes of its tokens and the
number of the sweep, so results depend neither on how the work is dealt nor on tasks that are repeated. After `BURN_IN`
sweeps the predictive probabilities are averaged over `SAMPLES` ones.

The work is dealt by pair: texts are read in blocks of `BLOCK_TOKENS`; a block tells each shard of the space of pairs' hashes
the distinct pairs that it holds, with their training counts, and each home (a shard of the space of tokens' hashes) its
distinct tokens. There is a shard for each `SHARD_BYTES` of text. A shard adds up all blocks' counts and draws its pairs'
tables; between two sweeps it tells the homes of its words and contexts its sums of tables, and is told their sums over all
shards. A frequent word or context is so spread over all shards, and no vocabulary is ever in one place: a worker holds one
block, one shard or one home. At the end each block is answered in its own order and scores its texts.

Tokens are known by 64-bit hashes: two tokens of V share one with odds V**2 / 2**65.

Defined cases: a null or empty text is its end token alone; with no training row all probabilities are 1; rows that repeat
are scored each, and trained on each; null doc_ids are kept; the result has doc_id and the scores, no other columns.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common, vec

BLOCK_TOKENS = 1 << 22
SHARD_BYTES = 32 << 20
DISCOUNT = 0.5  # the draws' closed form holds for this one
STRENGTH, PLACE = 0.5, 2.0
BURN_IN, SAMPLES = 2, 3
STATE = -1  # in place of the shard that a message comes from
END = np.uint64(0x45D9F3B3335B369D)
START = np.uint64(0x9D39247E33776D41)
UNSEEN = np.uint64(0x2B992DDFA23249D6)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 1 << 16  # weights are summed as multiples of 1 / _UNIT, so that their order doesn't matter


def pack(*arrays: np.ndarray) -> bytes:
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        body = raw.view(np.uint8).reshape(len(raw), -1).T.tobytes() if raw.itemsize > 1 and len(raw) else raw.tobytes()  # bytes of equal weight together
        out.append(struct.pack("<3sq", raw.dtype.str[1:].encode().ljust(3), len(raw)) + body)
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<3sq", raw, at)
        kind, at = np.dtype("<" + kind.decode().strip()), at + struct.calcsize("<3sq")
        flat = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        out.append(np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).view(kind).reshape(n) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def gaps(hashes: np.ndarray) -> np.ndarray:
    return np.diff(hashes, prepend=np.uint64(0))


def ungap(gap: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(gap, dtype=np.uint64)


def _counts(x: np.ndarray) -> np.ndarray:
    """In the smallest type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x.astype(np.uint8)


# --- random draws, all from keys and counters ---------------------------------


def uniform(key: np.ndarray, *counters: int) -> np.ndarray:
    """A number in (0, 1) for each key and these counters."""
    with np.errstate(over="ignore"):
        for c in counters:
            key = vec.mix(key + np.uint64(2 * c + 1) * _GOLDEN)
    return ((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gamma(shape: np.ndarray, key: np.ndarray, sweep: int) -> np.ndarray:
    """Gamma variates of scale 1, by Marsaglia and Tsang's rejection; below shape 1, of one more and then scaled down."""
    small = shape < 1
    d = shape + small - 1 / 3
    c = 1 / np.sqrt(9 * d)
    out, left, attempt = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(left):
        own = key[left]
        x = np.sqrt(-2 * np.log(uniform(own, sweep, 3 * attempt))) * np.cos(2 * np.pi * uniform(own, sweep, 3 * attempt + 1))
        v = (1 + c[left] * x) ** 3
        positive = np.maximum(v, 1e-300)
        good = (v > 0) & (np.log(uniform(own, sweep, 3 * attempt + 2)) < x * x / 2 + d[left] * (1 - positive + np.log(positive)))
        out[left[good]] = (d[left] * v)[good]
        left, attempt = left[~good], attempt + 1
    some = np.flatnonzero(small)
    out[some] *= uniform(key[some], sweep, 1 << 20) ** (1 / shape[some])
    return out


def draw_tables(n: np.ndarray, a: np.ndarray, u: np.ndarray) -> np.ndarray:
    """For each dish of n customers its number of tables t, of odds S(n, t) * a**t, from a uniform number u.

    S(n, t) = (2n - t - 1)! / ((n - t)! (t - 1)!) / 4**(n - t), so the odds of t + 1 to t are 4a (n - t) / (t (2n - t - 1)),
    which fall with t: the mode is where they pass 1, and the odds are summed from there to both sides, twice.
    """
    n, last = n.astype(np.float64), 2 * n.astype(np.float64) - 1
    ratio = lambda t, n, last, a: 4 * a * (n - t) / (t * (last - t))
    half = (last + 4 * a) / 2
    mode = np.clip(np.ceil(4 * a * n / (half + np.sqrt(np.maximum(half * half - 4 * a * n, 0)))), 1, n)

    def steps(up: bool, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Dishes, tables and odds against the mode's, one step further away each time, until nothing is left to add."""
        t, odds, (m, end, b) = mode[left], np.ones(len(left)), (n[left], last[left], a[left])
        while True:
            more = np.flatnonzero((t < m) if up else (t > 1))
            left, t, odds, m, end, b = (x[more] for x in (left, t, odds, m, end, b))
            if not len(left):
                return
            odds = odds * ratio(t, m, end, b) if up else odds / ratio(t - 1, m, end, b)
            t = t + 1 if up else t - 1
            more = np.flatnonzero(odds > 1e-18)
            left, t, odds, m, end, b = (x[more] for x in (left, t, odds, m, end, b))
            yield left, t, odds

    every = np.flatnonzero(n > 1)
    total = np.ones(len(n))
    for up in (True, False):
        for at, _, odds in steps(up, every):
            total[at] += odds
    out, rest = mode.copy(), u * total - 1  # what is left when the mode has taken its share
    left = every[rest[every] > 0]
    for up in (True, False):
        for at, t, odds in steps(up, left):
            open_ = rest[at] > 0
            at, t, odds = at[open_], t[open_], odds[open_]
            out[at] = t
            rest[at] -= odds
        left = left[rest[left] > 0]
    return out.astype(np.int64)


def seat(word: np.ndarray, context: np.ndarray, n: np.ndarray, words: np.ndarray, contexts: np.ndarray, weight: np.ndarray, in_context: np.ndarray, sweep: int) -> np.ndarray:
    """A sweep's tables of all pairs. word, context: as places in their hashes; weight: of each word at the parent; in_context: tables of each context."""
    g = gamma(STRENGTH / DISCOUNT + in_context, contexts, 2 * sweep)
    with np.errstate(over="ignore"):
        key = vec.mix(words[word] * np.uint64(3) + contexts[context])
    return draw_tables(n, DISCOUNT * g[context] * weight[word], uniform(key, 2 * sweep))


def weights(customers: np.ndarray, words: np.ndarray, sweep: int) -> np.ndarray:
    """Of each word at the parent, as whole multiples of 1 / _UNIT, before they are divided by their sum."""
    return np.maximum(1, np.rint(gamma(PLACE + customers, words, 2 * sweep + 1) * _UNIT)).astype(np.int64)


def unseen_weight(sweep: int) -> int:
    """Of the place of all words outside the vocabulary."""
    return int(weights(np.zeros(1), np.array([UNSEEN]), sweep)[0])


# --- blocks, shards and homes -----------------------------------------------


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, ends among them, and where each text's begin."""
    data, offsets = vec.buffers(texts)
    starts, ends = vec.spans(data, offsets, ~vec.SPACE)
    words, n = vec.hashes(data, starts, ends), len(texts)
    words[(words == END) | (words == START)] ^= np.uint64(1)
    at = vec.bounds(vec.owners(offsets, starts), n)
    place = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(at))
    out = np.full(len(words) + n, END, np.uint64)
    out[place] = words
    return out, at + np.arange(n + 1)


def pair_shards(word: np.ndarray, context: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((vec.mix(word * _GOLDEN + context) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def home_cuts(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each home's part of sorted hashes begins; homes are equal ranges."""
    edge = [(1 << 64) * p // shards for p in range(shards)]
    return np.concatenate([np.searchsorted(hashes, np.array(edge, np.uint64)), [len(hashes)]])


class Block:
    """Some texts' tokens, gathered slice by slice."""

    def __init__(self) -> None:
        self.word, self.ids, self.long, self.held, self.n = [], [], [], [], 0

    def add(self, part: pa.RecordBatch) -> None:
        word, at = tokens(part.column("text"))
        self.word.append(word)
        self.ids += part.column("doc_id").to_pylist()
        self.long.append(np.diff(at))
        self.held.append(part.column("held_out").to_numpy(zero_copy_only=False).astype(bool))
        self.n += len(word)

    def packed(self) -> tuple[bytes, int]:
        """The texts as numbers of tokens, and the number of training tokens. Frequent tokens have small numbers, which pack well."""
        word, long, held = (np.concatenate(x) for x in (self.word, self.long, self.held))
        vocabulary, index = np.unique(np.append(word, START), return_inverse=True)
        often = np.argsort(-np.bincount(index, minlength=len(vocabulary)), kind="stable")
        rank = np.empty(len(vocabulary), np.uint32)
        rank[often] = np.arange(len(vocabulary))
        return pack(gaps(vocabulary), rank, rank[index[:-1]], _counts(long), held), int(long[~held].sum())


class Texts:
    """A block, unpacked: its vocabulary, its texts as places in it, and, when asked for, its distinct pairs (`pair_word`, `pair_context`) with each token's place among them (`of`)."""

    def __init__(self, body: bytes) -> None:
        gap, rank, index, long, self.held = unpack(body)
        self.vocabulary, self.long = ungap(gap), long.astype(np.int64)
        self.index, self.start = np.argsort(rank).astype(np.int32)[index], int(np.searchsorted(self.vocabulary, START))

    def with_pairs(self) -> Texts:
        before, size = np.empty_like(self.index), len(self.vocabulary)
        before[1:] = self.index[:-1]
        before[np.cumsum(self.long) - self.long] = self.start
        key = self.index.astype(np.int64) * size
        key += before
        pair, of = np.unique(key, return_inverse=True)
        self.of, self.pair_word, self.pair_context = of.astype(np.int32), (pair // size).astype(np.int32), (pair % size).astype(np.int32)
        return self

    def dealt(self, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in order of their shards, and where each shard's begin."""
        shard = pair_shards(self.vocabulary[self.pair_word], self.vocabulary[self.pair_context], shards)
        order = np.argsort(shard, kind="stable")
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def token_counts(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """What each home is told of tokens: training counts."""
        vocabulary = self.vocabulary
        known = np.bincount(self.index[np.repeat(~self.held, self.long)], minlength=len(vocabulary))
        known[self.start] = int((~self.held).sum())  # customers of the context
        cut = home_cuts(vocabulary, shards)
        for q in range(shards):
            if cut[q] < cut[q + 1]:
                yield q, pack(gaps(vocabulary[cut[q] : cut[q + 1]]), _counts(known[cut[q] : cut[q + 1]]))

    def pair_counts(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """What each shard is told of pairs: training counts."""
        self.with_pairs()
        trained = np.bincount(self.of[np.repeat(~self.held, self.long)], minlength=len(self.pair_word))
        order, bound = self.dealt(shards)
        for p in range(shards):
            some = order[bound[p] : bound[p + 1]]
            if len(some):
                yield p, pack_pairs(self.vocabulary, self.pair_word[some], self.pair_context[some], _counts(trained[some]))


def pack_pairs(hashes: np.ndarray, word: np.ndarray, context: np.ndarray, *values: np.ndarray) -> bytes:
    """Pairs in order of word and context, as places in hashes, with their values."""
    used = np.unique(np.concatenate([word, context]))
    place = np.zeros(len(hashes), np.uint32)
    place[used] = np.arange(len(used))
    return pack(gaps(hashes[used]), _counts(np.bincount(place[word], minlength=len(used))), place[context], *values)


def unpack_pairs(blob: bytes) -> tuple[np.ndarray, ...]:
    """Words' and contexts' hashes, the pairs as places in them, and their values."""
    gap, n, at, *values = unpack(blob)
    hashes, words, contexts = ungap(gap), np.flatnonzero(n), np.unique(at)
    place = np.zeros(len(hashes), np.int32)
    place[contexts] = np.arange(len(contexts))
    return hashes[words], hashes[contexts], np.repeat(np.arange(len(words), dtype=np.int32), n[words]), place[at], *values


def merge(blobs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The place of each block's pairs among the shard's; the shard's words and contexts; and its pairs' words, contexts and training counts."""
    own = [unpack_pairs(x) for x in blobs]
    words, contexts = (np.unique(np.concatenate([x[j] for x in own])) for j in (0, 1))
    width = max(len(contexts), 1)
    keys, counts = [], []
    while own:  # what is read goes at once
        x = own.pop(0)
        keys.append(np.searchsorted(words, x[0])[x[2]] * width + np.searchsorted(contexts, x[1])[x[3]])
        counts.append(x[4])
    pairs = np.unique(np.concatenate(keys))
    places, count = [np.searchsorted(pairs, k).astype(np.int32) for k in keys], np.zeros(len(pairs), np.int64)
    for k, n in zip(places, counts, strict=True):
        count[k] += n
    return places, words, contexts, pairs // width, pairs % width, count


def summed(hashes: list[np.ndarray], values: list[np.ndarray], among: np.ndarray) -> np.ndarray:
    """Sums over several sorted lists of tokens, for the tokens in `among`, which holds them all."""
    total = np.zeros(len(among), np.int64)
    for h, v in zip(hashes, values, strict=True):
        total[np.searchsorted(among, h)] += v.astype(np.int64)
    return total


def messages(shards: int, words: np.ndarray, of_words: np.ndarray, contexts: np.ndarray, of_contexts: np.ndarray) -> list[tuple[int, bytes]]:
    """A shard's values of its words and its contexts, to their homes."""
    a, b = home_cuts(words, shards), home_cuts(contexts, shards)
    part = lambda x, cut, q: x[cut[q] : cut[q + 1]]
    return [
        (q, pack(gaps(part(words, a, q)), _counts(part(of_words, a, q)), gaps(part(contexts, b, q)), _counts(part(of_contexts, b, q))))
        for q in range(shards) if a[q] < a[q + 1] or b[q] < b[q + 1]
    ]


class Home:
    """Tokens of one range of hashes: n training customers of each (as context), and the tables that every pair has."""

    def __init__(self, blob: bytes) -> None:
        gap, self.n, of_word, of_context = unpack(blob)
        self.hashes, self.of_word, self.of_context = ungap(gap), of_word.astype(np.int64), of_context.astype(np.int64)

    def totals(self, told: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Customers at the parent and tables in the restaurant, with what the shards tell of tables beyond the first."""
        return self.of_word + summed([ungap(x[0]) for x in told], [x[1] for x in told], self.hashes), self.of_context + summed([ungap(x[2]) for x in told], [x[3] for x in told], self.hashes)


def bound(f: Callable, *args: object) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: f(pdf, *args)


def perplexity(log10: float, n: int) -> float:
    return 10 ** (-log10 / max(n, 1))


def shards_for(texts: DataFrame, text: str = "text") -> int:
    """One for each SHARD_BYTES, so that none grows with the corpus."""
    return max(1, -(-int(texts.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0) // SHARD_BYTES))


def score(docs: DataFrame, held: Column, text: str = "text", doc_id: str = "doc_id", block_tokens: int = BLOCK_TOKENS, shards: int | None = None, burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. held: over doc_id, which rows aren't learned from."""
    spark = docs.sparkSession
    shards = shards or shards_for(docs, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("held_out", held)
    id_type = docs.schema[doc_id].dataType
    kinds = {"block": pa.int64(), "body": pa.binary(), "ids": pa.list_(to_arrow_type(id_type)), "trained": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, number = Block(), TaskContext.get().partitionId() << 32

        def told() -> pa.RecordBatch:
            body, trained = block.packed()
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((number, body, block.ids, trained), kinds.values(), strict=True)], list(kinds))

        for batch in batches:
            for part in vec.slices(batch):
                block.add(part)
                if block.n >= block_tokens:
                    yield told()
                    block, number = Block(), number + 1
        if block.n:
            yield told()

    def dealt(counts: Callable[[Texts, int], Iterator[tuple[int, bytes]]]) -> DataFrame:
        """Made anew from the stored blocks for each use, so that it lies nowhere but in the shuffle."""

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    for p, body in counts(Texts(batch.column("body")[i].as_py()), shards):
                        yield pa.RecordBatch.from_arrays([batch.column("block").slice(i, 1), pa.array([p], pa.int32()), pa.array([body], pa.binary())], ["block", "shard", "body"])

        return texts.select("block", "body").mapInArrow(deal, "block long, shard int, body binary")

    texts = common.cut_by(rows.mapInArrow(read, f"block long, body binary, ids array<{id_type.simpleString()}>, trained long"), max(common.partitions(spark), 2 * shards), "block")
    of_tokens, of_pairs = dealt(Texts.token_counts), dealt(Texts.pair_counts)
    train_tokens = int(texts.agg(F.sum("trained")).first()[0] or 0)
    common.free(spark, wait=0.3)  # the shuffle's files go: what follows reads the blocks where they lie
    message = "shard int, part int, body binary"

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["shard", "part", "body"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        """A shard's pairs of several customers, and how many pairs each of its tokens has."""
        _, words, contexts, word, context, n = merge(pdf.sort_values("block")["body"].tolist())
        p, seen, many = int(pdf["shard"].iloc[0]), n > 0, n > 1
        every = np.unique(np.concatenate([words, contexts]))
        state = pack_pairs(every, np.searchsorted(every, words)[word[many]], np.searchsorted(every, contexts)[context[many]], _counts(n[many]), np.zeros(int(many.sum()), np.uint8))
        told = messages(shards, words, np.bincount(word[seen], minlength=len(words)), contexts, np.bincount(context[seen], minlength=len(contexts)))
        return frame([(p, STATE, state), *((q, p, body) for q, body in told)])

    def settle(counted: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        """A home's tokens, from the blocks' counts and the shards'; its words and their customers at the parent, in which each pair has one table."""
        counted, bodies = [unpack(x) for x in counted["body"]], [unpack(x) for x in told["body"]]
        hashes = np.unique(np.concatenate([ungap(x[0]) for x in counted]))
        n = summed([ungap(x[0]) for x in counted], [x[1] for x in counted], hashes)
        word, context = (summed([ungap(x[j]) for x in bodies], [x[j + 1] for x in bodies], hashes) for j in (0, 2))
        return pd.DataFrame({"shard": told["shard"].iloc[:1], "part": STATE, "body": [pack(gaps(hashes), _counts(n), _counts(word), _counts(context))], "words": int((word > 0).sum()), "customers": int(word.sum())})

    gathered = common.cut(of_pairs.groupBy("shard").applyInPandas(gather, message))
    states = gathered.where(F.col("part") == STATE)
    homes = common.cut(of_tokens.groupBy("shard").cogroup(gathered.where(F.col("part") != STATE).groupBy("shard")).applyInPandas(settle, f"{message}, words long, customers long"))
    vocabulary, first_customers = (int(x or 0) for x in homes.agg(F.sum("words"), F.sum("customers")).first())
    homes = homes.select("shard", "part", "body")

    def reply(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
        """To each shard, in its own order: its words' customers at the parent and its contexts' tables, over all shards. Besides, the home's sum of weights, and after a sample its totals."""
        home, told = Home(pdf.loc[pdf["part"] == STATE, "body"].iloc[0]), pdf[pdf["part"] != STATE]
        bodies = [unpack(x) for x in told["body"]]
        customers, in_context = home.totals(bodies)
        words = home.of_word > 0
        total = int(weights(customers[words], home.hashes[words], k).sum())
        back = [pack(_counts(customers[np.searchsorted(home.hashes, ungap(x[0]))]), _counts(in_context[np.searchsorted(home.hashes, ungap(x[2]))])) for x in bodies]
        q = int(pdf["shard"].iloc[0])
        kept = pack(_counts(customers), _counts(in_context)) if k > burn_in else None
        return pd.DataFrame([(int(p), q, body, 0) for p, body in zip(told["part"], back, strict=True)] + [(q, STATE, kept, total)], columns=["shard", "part", "body", "weight"])

    def parts(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        return unpack_pairs(pdf.loc[pdf["part"] == STATE, "body"].iloc[0])

    def told_of(p: int, words: np.ndarray, contexts: np.ndarray, word: np.ndarray, context: np.ndarray, tables: np.ndarray) -> list[tuple]:
        more = tables - 1
        told = messages(shards, words, np.bincount(word, more, len(words)).astype(np.int64), contexts, np.bincount(context, more, len(contexts)).astype(np.int64))
        return [(q, p, body) for q, body in told]

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        words, contexts, word, context, n, _ = parts(pdf)
        return frame(told_of(int(pdf["shard"].iloc[0]), words, contexts, word, context, np.ones(len(n), np.int64)))

    def sweep(pdf: pd.DataFrame, k: int, total: int) -> pd.DataFrame:
        words, contexts, word, context, n, sums = parts(pdf)
        replies = [unpack(x) for x in pdf[pdf["part"] != STATE].sort_values("part")["body"]]
        customers, in_context = (np.concatenate([x[j] for x in replies] or [np.zeros(0)]) for j in (0, 1))
        p = int(pdf["shard"].iloc[0])
        tables = seat(word, context, n, words, contexts, weights(customers, words, k) / total, in_context, k)
        sums = sums.astype(np.int64) + (tables if k >= burn_in else 0)
        every = np.unique(np.concatenate([words, contexts]))
        state = pack_pairs(every, np.searchsorted(every, words)[word], np.searchsorted(every, contexts)[context], n, _counts(sums))
        return frame([(p, STATE, state), *told_of(p, words, contexts, word, context, tables)])

    told = states.groupBy("shard").applyInPandas(begin, message)
    del gathered
    taken = []  # the homes' totals of each sample but the last
    for k in range(burn_in + samples):
        common.free(spark)
        replies = common.cut(homes.unionByName(told).groupBy("shard").applyInPandas(bound(reply, k), f"{message}, weight long"))
        total = int(replies.agg(F.sum("weight")).first()[0] or 0) + unseen_weight(k)
        if k > burn_in:
            taken.append(replies.where(F.col("part") == STATE).select("shard", "body"))
        both = states.unionByName(replies.where(F.col("part") != STATE).select("shard", "part", "body"))
        out = common.cut(both.groupBy("shard").applyInPandas(bound(sweep, k, total), message))
        states, told = out.where(F.col("part") == STATE), out.where(F.col("part") != STATE)
        del replies, both, out

    def finally_tokens(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """To each block: its tokens' training counts, and their customers at the parent and tables in each sample, after the first as differences."""
        home, out = Home(known.loc[known["sample"] == STATE, "body"].iloc[0]), []
        sums = [tuple(x.astype(np.int64) for x in unpack(known.loc[known["sample"] == s, "body"].iloc[0])) for s in range(samples - 1)]
        sums.append(home.totals([unpack(x) for x in known.loc[known["sample"] == samples - 1, "body"]]))
        for body in asked["body"]:
            at = np.searchsorted(home.hashes, ungap(unpack(body)[0]))
            out.append(pack(home.n[at], *(_counts(sums[0][j][at]) for j in (0, 1)), *((sums[s][j][at] - sums[0][j][at]).astype(np.int32) for s in range(1, samples) for j in (0, 1))))
        return pd.DataFrame({"block": asked["block"], "kind": "tokens", "shard": asked["shard"], "body": out})

    def finally_pairs(asked: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        """To each block: its pairs' training counts, and their tables summed over the samples."""
        asked = asked.sort_values("block")
        places, _, _, _, _, n = merge(asked["body"].tolist())
        tables = np.minimum(n, 1) * samples
        tables[n > 1] = unpack(state["body"].iloc[0])[4]  # in the state's order
        return pd.DataFrame({"block": asked["block"], "kind": "pairs", "shard": asked["shard"], "body": [pack(_counts(n[k]), _counts(tables[k])) for k in places]})

    common.free(spark)
    known = homes.select("shard", "body", F.lit(STATE).alias("sample"))
    for s, x in enumerate([*taken, told]):
        known = known.unionByName(x.select("shard", "body", F.lit(s).alias("sample")))
    answer = "block long, kind string, shard int, body binary"
    for_tokens = of_tokens.groupBy("shard").cogroup(known.groupBy("shard")).applyInPandas(finally_tokens, answer)
    for_pairs = of_pairs.groupBy("shard").cogroup(states.groupBy("shard")).applyInPandas(finally_pairs, answer)
    answers = for_tokens.unionByName(for_pairs)
    out_schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").fields])

    def finish(mine: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if mine.empty:
            return pd.DataFrame(columns=out_schema.names)
        x = Texts(mine["body"].iloc[0]).with_pairs()
        per_token = [unpack(y) for y in answers[answers["kind"] == "tokens"].sort_values("shard")["body"]]
        n, customers, tables, *more = (np.concatenate([y[j] for y in per_token]).astype(np.int64) for j in range(1 + 2 * samples))
        per_pair = [unpack(y) for y in answers[answers["kind"] == "pairs"].sort_values("shard")["body"]]
        order, count, of_tables = x.dealt(shards)[0], np.empty(len(x.pair_word)), np.empty(len(x.pair_word))
        count[order], of_tables[order] = (np.concatenate([y[j] for y in per_pair]) for j in (0, 1))
        p, places = (count - DISCOUNT * of_tables / samples) / (STRENGTH + n[x.pair_context]), PLACE * (vocabulary + 1)
        for s in range(samples):
            c, t = (customers, tables) if not s else (customers + more[2 * s - 2], tables + more[2 * s - 1])
            root = (c + PLACE) / (totals[s] + places)
            p += ((STRENGTH + DISCOUNT * t) / (STRENGTH + n))[x.pair_context] * root[x.pair_word] / samples
        at = np.cumsum(x.long) - x.long
        known = n[x.index].astype(np.float64)
        add = lambda v: np.add.reduceat(v, at)  # noqa: E731  every text has a token
        return pd.DataFrame({
            "doc_id": pd.array(mine["ids"].iloc[0], dtype=object), "held_out": x.held.astype(bool), "n_tokens": x.long, "n_known": add((known > 0).astype(np.int64)), "train_tokens": train_tokens,
            "base_score": add(np.log10(known + 1)) - x.long * np.log10(train_tokens + vocabulary + 1.0), "score": add(np.log10(p)[x.of]),
        })

    first = [x.mapInArrow(_customers, "n long").agg(F.sum("n")).first()[0] for x in (*(x.select("body", F.lit(0).alias("told")) for x in taken), told.select("body", F.lit(1).alias("told")))]
    totals = [int(x or 0) for x in first]
    totals[-1] += first_customers
    return texts.select("block", "body", "ids").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, out_schema)


def _customers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the words' values in each row: of a home's totals, or (told) of a shard's message, in which tokens come before."""
    for batch in batches:
        bodies, told = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([int(unpack(x)[k].astype(np.int64).sum()) for x, k in zip(bodies, told, strict=True)], pa.int64())], ["n"])


def held_out(doc_id: str = "doc_id") -> Column:
    return common.fold(doc_id, 7) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"), held_out())
