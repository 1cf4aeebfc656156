"""Toxicity by maximum-scoring segments.

Tokens are runs of letters and digits, lower-cased, as 64-bit hashes. From labelled documents, each token gets a log-odds of
toxic against clean under an informative Dirichlet prior (the pooled rates, as `PRIOR` pseudo-counts), less `CAUTION` of its
standard errors and less `DRIFT`; what isn't positive then counts -DRIFT. Toxic occurrences count once for each distinct
pair of neighbours, so that copies of one text are one piece of evidence. A linear scan over a text's token
scores (all maximal-scoring segments, each found once, by the stack of Ruzzo and Tompa, in which each segment knows the next
one to its left that begins lower, so that all searches together are linear; runs of equal negative scores are
one step) gives its passages. By extreme-value statistics a passage of score S in n tokens has E-value K n exp(-lambda S):
lambda solves sum p exp(lambda s) = 1 over the clean tokens, K comes from the clean documents' passages. The bits of the
best passage and of all significant ones feed a logistic calibration.

The fit uses a bounded sample: about `LEARN_ROWS` labelled rows, by a hash of doc_id; three quarters of it set the log-odds,
the rest the calibration. Scoring reads all of every text; its cost is linear in the text.

Defined cases: a null or empty text has no passage and gets the score of a text without any; rows whose label is null, or
that have none, aren't learned from; a document with several labels is learned from with each; with no label of one kind all
scores are 0; repeated rows repeat; other columns stay (but passages, score and predicted, which are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import common, vec

PRIOR, CAUTION, DRIFT = 200.0, 3.0, 0.5
#: Tokens of fewer distinct toxic occurrences have no positive score.
SUPPORT = 4
LEARN_ROWS = 20_000
SIGNIFICANT = 0.05
PASSAGES = "passages array<struct<start:long,end:long,bits:double>>"


class Model(NamedTuple):
    tokens: np.ndarray  # sorted hashes of those with a positive score
    scores: np.ndarray
    lam: float
    k: float
    weights: np.ndarray  # of 1, the best passage's bits, the significant passages' bits


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends (in bytes) of all tokens, and where each text's begin; starts count from the first text's."""
    data, offsets = vec.buffers(texts)
    starts, ends = vec.spans(data, offsets, vec.WORD)
    return vec.hashes(data, starts, ends), starts, ends, vec.bounds(vec.owners(offsets, starts), len(texts))


def segments(place: list[int], score: list[float], drift: float) -> list[tuple[int, int, float]]:
    """First and last token and score of all maximal-scoring segments; place and score: of the tokens with a positive score, all others count -drift."""
    stack: list[tuple[int, int, float, float, int]] = []  # first, last, sum before it, sum with it, the next one down whose sum before is smaller
    total, last = 0.0, -1
    for i, s in zip(place, score, strict=True):
        total -= drift * (i - last - 1)
        first, before, below = i, total, len(stack) - 1
        total += s
        while True:
            while below >= 0 and stack[below][2] >= before:
                below = stack[below][4]  # what is passed here is never looked at again: what comes next starts from this segment's link
            if below < 0 or stack[below][3] >= total:
                break
            first, _, before, _, link = stack[below]
            del stack[below:]
            below = link
        stack.append((first, i, before, total, below))
        last = i
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def log_odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float, prior: float = PRIOR, caution: float = CAUTION, drift: float = DRIFT) -> np.ndarray:
    """From a token's occurrences in each kind, and those of all tokens."""
    alpha = 0.5 + prior * (toxic + clean) / (all_toxic + all_clean)  # half an occurrence more, so that a token unseen in one kind has a bounded error
    y, n = toxic + alpha, clean + alpha
    delta = np.log(y / (all_toxic + prior - y)) - np.log(n / (all_clean + prior - n))
    low = delta - caution * np.sqrt(1 / y + 1 / n)
    return np.where(low > drift, low - drift, -drift)


def decay(rates: np.ndarray, scores: np.ndarray) -> float:
    """lambda > 0 with sum rates * exp(lambda * scores) = 1."""
    value, inverse = np.unique(scores, return_inverse=True)
    p = np.bincount(inverse, rates)
    f = lambda x: np.log((p * np.exp(np.minimum(x * value, 700))).sum())
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return low


def bits(model: Model, n: int, score: float) -> float:
    """How far -ln of the E-value is over that of a passage that is just significant."""
    return model.lam * score - np.log(model.k * max(n, 1)) + np.log(SIGNIFICANT)


def features(model: Model, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
    b = [bits(model, n, s) for _, _, s in found]
    return 1.0, float(np.clip(max(b, default=-20), -20, 40)), float(np.log1p(sum(x for x in b if x > 0)))


def passages(model: Model, texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
    """For each text its number of tokens, its segments, and starts and ends of its tokens."""
    token, starts, ends, at = tokens(texts)
    maybe = np.zeros(1 << 16, bool)
    maybe[model.tokens >> np.uint64(48)] = True
    hits = np.flatnonzero(maybe[token >> np.uint64(48)])
    where = np.minimum(np.searchsorted(model.tokens, token[hits]), len(model.tokens) - 1)
    right = model.tokens[where] == token[hits] if len(model.tokens) else np.zeros(0, bool)
    hits, score = hits[right], model.scores[where[right]] if len(model.tokens) else model.scores
    cut = np.searchsorted(hits, at)
    for i in range(len(texts)):
        own = hits[cut[i] : cut[i + 1]]
        yield int(at[i + 1] - at[i]), segments((own - at[i]).tolist(), score[cut[i] : cut[i + 1]].tolist(), DRIFT) if len(own) else [], starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = LEARN_ROWS, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic") -> Model | None:
    """learn: over doc_id, which rows may be learned from."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).alias("toxic")).where(learn & F.col("toxic").isNotNull())
    n = known.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    drawn = known.where(place < F.lit(int((1 << 30) * min(1.0, rows / max(n, 1))))).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(4)))
    sample = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    sample = common.cut(sample)  # some LEARN_ROWS rows at most, read three times

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Toxic: each token with its neighbours once. Clean: each token with its number, for each batch."""
        for batch in batches:
            for part in vec.slices(batch):
                token, _, _, at = tokens(part.column("text"))
                toxic_token = np.repeat(part.column("toxic").to_numpy() > 0, np.diff(at))
                beside = np.concatenate([[np.uint64(1)], token, [np.uint64(1)]])
                with np.errstate(over="ignore"):
                    around = vec.mix(beside[:-2] * np.uint64(3) + beside[2:])
                pair = np.unique(np.stack([token[toxic_token], around[toxic_token]]), axis=1) if toxic_token.any() else np.zeros((2, 0), np.uint64)
                word, number = np.unique(token[~toxic_token], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([pair[0], word]).view(np.int64)), pa.array([*pair[1].view(np.int64).tolist(), *[None] * len(word)], pa.int64()), pa.array(np.concatenate([np.zeros(pair.shape[1], np.int64), number]))], ["token", "around", "n"])

    held = sample.where("part != 0").select("text", "toxic").mapInArrow(count, "token long, around long, n long")
    by_token = common.cut(held.groupBy("token", "around").agg(F.sum("n").alias("n")).groupBy("token").agg(F.count("around").alias("t"), F.sum("n").alias("n")))
    all_t, all_n = by_token.agg(F.sum("t"), F.sum("n")).first()
    if not all_t or not all_n:
        return None
    able = by_token.where(F.col("t") >= SUPPORT).toPandas()  # at most the sample's toxic tokens / SUPPORT
    t, c = able["t"].to_numpy(float), able["n"].to_numpy(float)
    value = log_odds(t, c, all_t, all_n)
    good = np.flatnonzero(value > 0)
    good = good[np.argsort(able["token"].to_numpy(np.int64)[good].view(np.uint64))]
    rate = np.concatenate([(c[good] + 0.5) / all_n, [0.0]])
    rate[-1] = max(1e-9, 1 - rate.sum())
    model = Model(able["token"].to_numpy(np.int64)[good].view(np.uint64), value[good], decay(rate, np.concatenate([value[good], [-DRIFT]])), 1.0, np.zeros(3))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch):
                found = list(passages(model, part.column("text")))
                yield pa.RecordBatch.from_arrays([(part.column("toxic")), pa.array([x[0] for x in found], pa.int64()), pa.array([[s for _, _, s in x[1]] for x in found], pa.list_(pa.float64()))], ["toxic", "n", "s"])

    seen = sample.where("part = 0").select("text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(measure, "toxic long, n long, s array<double>").collect()
    clean = [r for r in seen if not r["toxic"]]
    all_s = sorted(s for r in clean for s in r["s"])
    s0 = all_s[len(all_s) // 2] if all_s else float(max(model.scores, default=1.0))
    k = (sum(s >= s0 for s in all_s) + 0.5) / max(1.0, sum(r["n"] for r in clean)) * np.exp(min(model.lam * s0, 600.0))
    model = model._replace(k=float(k))
    x = np.array([features(model, r["n"], [(0, 0, s) for s in r["s"]]) for r in seen]).reshape(-1, 3)
    y = np.array([r["toxic"] > 0 for r in seen], float)
    return model._replace(weights=_logistic(x, y))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """By Newton's steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with `passages` (the significant ones, as positions in the text), `score` and `predicted`."""
    rest = [c for c in docs.columns if c not in ("passages", "score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in rest), *T.StructType.fromDDL(f"{PASSAGES}, score double, predicted int").fields])
    at = rest.index(text)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, rest)
            for part in vec.slices(batch, text):
                spans, scores = [], np.zeros(part.num_rows)
                texts = part.column(at)
                begins = vec.buffers(texts, lower=False)[1]
                for i, (n, found, starts, ends) in enumerate(passages(model, texts) if model else ((0, [], None, None) for _ in range(part.num_rows))):
                    own = []
                    if model:
                        scores[i] = 1 / (1 + np.exp(-np.clip(np.dot(features(model, n, found), model.weights), -30, 30)))
                    good = [(a, b, v) for a, b, s in found if (v := bits(model, n, s)) > 0]
                    raw = texts[i].as_py().encode() if good else b""
                    for a, b, v in good:
                        own.append({"start": len(raw[: starts[a] - begins[i]].decode()), "end": len(raw[: ends[b] - begins[i]].decode()), "bits": v})
                    spans.append(own)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], schema.names)

    return docs.select(*rest).mapInArrow(each, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return common.fold(doc_id, 5) == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"), ~held_out())
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
