"""Language ID by string kernels.

A text's features are the presence of its character n-grams of 1 to 3 letters (a blended spectrum; letters lower-cased,
runs of all else one space), each known exactly by its code points in 63 bits. The kernel of two texts is the number of
n-grams that both hold, over the root of the product of their own numbers. Landmarks from the training rows give the Nyström
map, and a ridge regression for each language against the rest is solved in its space. A text's n-grams are looked up among
the landmarks', which gives its kernel with each, and the product with the weights its scores.

The fit uses a bounded sample: about `PER_LANGUAGE` distinct training texts of each language (all, if there are fewer), by a
hash of the text, of which `LANDMARKS` are landmarks, dealt evenly over languages. Prediction reads all of every text.

Defined cases: a text that is null or has no letter is `und` with score 0; rows with a null lang aren't learned from; if
there is nothing to learn from, all is `und`; ties go to the language that sorts first; other columns stay (but lang_pred
and score, which are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import common, vec

ORDERS = 3
PER_LANGUAGE, LANDMARKS, RIDGE = 300, 96, 1e-2
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # of all landmarks, sorted
    starts: np.ndarray  # of each n-gram's part of holders, and the end
    holders: np.ndarray  # the landmarks that hold it
    norms: np.ndarray  # roots of the landmarks' numbers of n-grams
    weights: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted n-grams that each text holds; and whether it has a letter."""
    letters, out, any_letter = _letters(), [np.zeros(0, np.int64)] * len(texts), np.zeros(len(texts), bool)
    for i, x in enumerate(texts):
        if not x:
            continue
        c = np.frombuffer(x.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letters[c]
        if not is_letter.any():
            continue
        any_letter[i] = True
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        c = np.where(is_letter, c, np.uint32(32))[keep].astype(np.int64)
        found, gram = [], np.zeros(len(c), np.int64)
        for n in range(1, min(ORDERS, len(c)) + 1):
            gram = gram[: len(c) - n + 1] << 21 | c[n - 1 :]
            found.append(np.unique(gram))
        out[i] = np.concatenate(found)  # longer ones are greater
    return out, any_letter


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Which of their n-grams each text holds, and whether it has a letter."""
    found, known = ngrams(texts)
    grams = np.unique(np.concatenate(found))
    return np.array([np.isin(grams, x) for x in found]), known


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two presence matrices over the same n-grams, as one matrix product."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    norm = np.sqrt(np.maximum(a.sum(1), 1))[:, None] * np.sqrt(np.maximum(b.sum(1), 1))
    return (a @ b.T) / norm


def index(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of landmarks, as in Model: memory follows their n-grams."""
    grams, holders = np.concatenate(texts), np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in texts])
    order = np.argsort(grams, kind="stable")
    found, starts = np.unique(grams[order], return_index=True)
    return found, np.append(starts, len(grams)), holders[order], np.sqrt([max(len(x), 1) for x in texts])


def against(texts: list[np.ndarray], grams: np.ndarray, starts: np.ndarray, holders: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """kernel() of texts with landmarks, by their index()."""
    out = np.zeros((len(texts), len(norms)), np.float32)
    for i, x in enumerate(texts):
        at = np.searchsorted(grams, x)
        at = at[at < len(grams)]
        at = at[grams[at] == x[: len(at)]]
        n = starts[at + 1] - starts[at]
        ends = np.cumsum(n)
        both = holders[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        out[i] = np.bincount(both, minlength=len(norms)) / norms / np.sqrt(max(len(x), 1))
    return out


def solve(langs: list[str], texts: list[np.ndarray], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """The one-versus-rest weights over the landmarks' kernel."""
    names = sorted(set(langs))
    place = {x: [i for i, y in enumerate(langs) if y == x] for x in names}
    chosen = [place[x][k] for k in range(len(langs)) for x in names if k < len(place[x])][:landmarks]
    some = [texts[i] for i in chosen]
    marks = index(some)
    value, vector = np.linalg.eigh(against(some, *marks).astype(np.float64))
    keep = value > 1e-6 * value[-1]
    to_space = vector[:, keep] / np.sqrt(value[keep])
    z = against(texts, *marks).astype(np.float64) @ to_space
    z = np.hstack([z, np.ones((len(z), 1))])
    weight = np.array([1 / len(place[x]) for x in langs])[:, None] * len(langs) / len(names)  # languages count alike
    y = np.where(np.array(langs)[:, None] == np.array(names), 1.0, -1.0)
    w = np.linalg.solve(z.T @ (weight * z) + ridge * np.eye(z.shape[1]), z.T @ (weight * y))
    return Model(names, *marks, np.vstack([to_space @ w[:-1], w[-1:]]).astype(np.float32))


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, text: str = "text", lang: str = "lang") -> Model | None:
    """From the rows of docs where `learn` holds."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.select("lang", F.xxhash64("text")).distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, per_language / n))])
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch):
                grams, known = ngrams(part.column("text").to_pylist())
                at = np.flatnonzero(known)
                yield pa.RecordBatch.from_arrays([part.column("lang").take(pa.array(at)), pa.array([grams[i].tobytes() for i in at], pa.binary())], ["lang", "grams"])

    found = drawn.mapInArrow(features, "lang string, grams binary").dropDuplicates().orderBy(F.xxhash64("grams"), "grams", "lang").collect()
    if not found:
        return None
    return solve([r["lang"] for r in found], [np.frombuffer(r["grams"], np.int64) for r in found], landmarks)


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with `lang_pred` and `score`."""
    rest = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = rest.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, rest)
            for part in (y.slice(i, 256) for y in vec.slices(batch, text) for i in range(0, y.num_rows, 256)):
                names, best = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if model:
                    grams, known = ngrams(part.column(at).to_pylist())
                    raw = against(grams, *model[1:5]) @ model.weights[:-1] + model.weights[-1]
                    top = raw.argmax(1)
                    names = np.where(known, np.array(model.languages, object)[top], UNKNOWN)
                    best = np.where(known, (np.clip(raw[np.arange(len(top)), top], -1, 1) + 1) / 2, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names.tolist(), pa.string()), pa.array(best.astype(np.float64))], schema.names)

    return docs.select(*rest).mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return common.fold(doc_id, 4) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
