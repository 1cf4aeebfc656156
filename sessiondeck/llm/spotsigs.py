"""SpotSigs: chains of content words that follow common words.

Tokens are runs of letters and digits, lower-cased. Each occurrence of a common word (ANCHORS), and the beginning of the
text, is an anchor; its signature is the anchor with the next `CHAIN` content words (words that aren't anchors; fewer at the
end of a text, but one at least). The fingerprint of a text is the sorted set of its signatures, of 64 bits each. A text with words but no content word has its whole word sequence as its one signature, and a text
without words its bytes, so only the empty text has an empty set. Likeness is the Jaccard coefficient of two sets.

Near-duplicates of a threshold t: a set of n signatures can only be as like one of t*n to n/t. Distinct sets are partitioned
by length, in steps of the factor 1/t, so partners are in the same or the next partition. In a partition, a set's
signatures are ordered from rare to frequent; two sets whose likeness reaches t share one of the first n - ceil(t*n) + 1,
and only sets that do are compared, with the upper bounds from what is left of both lists ending the comparison early.

Defined cases: null is the empty text; empty texts are like each other (1) and unlike all others (0); rows that repeat get
equal results; a table of one row is its own next document; with equal doc_ids the order is by the text's hash; null doc_id
sorts first.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common, graph, vec

#: The commonest function words of English, German, French and Spanish.
ANCHORS = (
    "the a an and or of to in is are was that it for with as on be by at from this have not you he they "
    "der die das und ist ein eine einen den dem des mit zu von nicht auf für im sich auch "
    "le la les un une et de du des est dans pour que qui au aux par sur pas "
    "el los las uno una y en con por para es del al se lo no su"
).split()
CHAIN = 2
THRESHOLD = 0.8
#: Ids that the cuts between ranges come from.
SAMPLE = 50_000


def signatures(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted signature set of each text."""
    data, offsets = vec.buffers(texts)
    starts, ends = vec.spans(data, offsets, vec.WORD)
    token, n = vec.hashes(data, starts, ends), len(offsets) - 1
    owner = vec.owners(offsets, starts)
    known = np.unique(vec.hash_of(ANCHORS))
    anchor = known[np.minimum(np.searchsorted(known, token), len(known) - 1)] == token if len(token) else np.zeros(0, bool)
    content = np.flatnonzero(~anchor)
    at = vec.bounds(owner, n)
    first = at[:-1][at[:-1] < at[1:]]  # a text's begin is an anchor too; its position comes before its first word
    place = np.concatenate([np.flatnonzero(anchor), first - 1])
    head = np.concatenate([token[anchor], np.full(len(first), 7, np.uint64)])
    of = np.concatenate([owner[anchor], owner[first]])
    k = np.searchsorted(content, place, "right")
    sig, some = head.copy(), np.zeros(len(place), bool)
    with np.errstate(over="ignore"):
        for j in range(chain):
            where = np.minimum(k + j, max(len(content) - 1, 0))
            there = (k + j < len(content)) & (owner[content[where]] == of) if len(content) else np.zeros(len(place), bool)
            sig = vec.mix(sig * np.uint64(0x9E3779B97F4A7C15) + (np.where(there, token[content[where]], 1) if len(content) else 1))
            if not j:
                some = there
    sig, of = sig[some], of[some]
    order = np.lexsort((sig, of))
    sig, of = sig[order], of[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (of[1:] != of[:-1])
    sig, of = sig[new], of[new]
    cut = vec.bounds(of, n)
    out = [sig[cut[i] : cut[i + 1]] for i in range(n)]
    for i in np.flatnonzero((np.diff(cut) == 0) & (np.diff(offsets) > 0)):
        raw = token[at[i] : at[i + 1]].tobytes() or data[offsets[i] : offsets[i + 1]].tobytes()
        out[i] = np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64)
    return out


def told(sigs: np.ndarray) -> str:
    """A fingerprint: 16 hex digits for each signature, in order. Two fingerprints' likeness is the Jaccard coefficient of their groups of 16."""
    return sigs.astype(">u8").tobytes().hex()


def untold(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray, floor: float = 0.0) -> float:
    """The Jaccard coefficient of two sorted sets; 0 at once where their lengths rule out more than the floor."""
    if not len(a) and not len(b):
        return 1.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or len(small) < floor * len(large):
        return 0.0
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both / (len(a) + len(b) - both)


def _dealt(docs: DataFrame, n: int, sample: int = SAMPLE) -> DataFrame:
    """docs (doc_id, text) in order of doc_id within partitions, by ranges; each range ends with guests, the rows of the id that follows it.

    The cuts between ranges come from a sample of at most some `sample` ids, and a range's first id from a count over all.
    """
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    ids = docs.select("doc_id").where("doc_id is not null")
    rate = min(1.0, sample / max(ids.count(), 1))
    drawn = sorted(r["doc_id"] for r in ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * rate))).distinct().collect())
    cuts = sorted({drawn[len(drawn) * i // n] for i in range(1, n)}) if drawn else []

    @F.arrow_udf("int")
    def part_of(keys: pa.Array) -> pa.Array:
        return pa.array([0 if x is None else bisect.bisect_right(cuts, x) for x in keys.to_pylist()], pa.int32())

    heads = docs.select(part_of("doc_id").alias("p"), "doc_id").groupBy("p").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("none")).orderBy("p").collect()  # a row for each range
    # a key for each range that Spark's hash deals to a partition of its own
    hashed = spark.range(0, 40 * n + 40).select(F.col("id").cast("int").alias("k"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("to")).groupBy("to").agg(F.min("k").alias("k")).collect()
    free = [r["k"] for r in sorted(hashed, key=lambda r: r["to"])]
    deal = {r["p"]: free[i % len(free)] for i, r in enumerate(heads)}
    before = {None if r["none"] else r["least"]: heads[i - 1]["p"] for i, r in enumerate(heads)}  # a head is a guest of the range before, the first one of the last

    @F.arrow_udf("array<struct<p:int,guest:int,deal:int>>")
    def places(keys: pa.Array) -> pa.Array:
        def of(x: object) -> list[dict]:
            homes = [(0 if x is None else bisect.bisect_right(cuts, x), 0), *([(before[x], 1)] if x in before else [])]
            return [{"p": p, "guest": guest, "deal": deal[p]} for p, guest in homes]

        return pa.array([of(x) for x in keys.to_pylist()], pa.list_(pa.struct([(c, pa.int32()) for c in ("p", "guest", "deal")])))

    rows = docs.select("doc_id", "text", F.inline(places("doc_id")))
    return rows.repartition(n, "deal").sortWithinPartitions("p", "guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).select("p", "guest", "doc_id", "text")


def against_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edits: a text whose last half is replaced by the beginning of the next one."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose successor is still to come: the last one

        def worked(held: list[tuple]) -> pa.RecordBatch:
            pairs = [(x, y) for x, y in zip(held, held[1:], strict=False) if not x[1]]
            texts, edits = [x[3] for x in held], [x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2] for x, y in pairs]
            own = signatures(pa.array(texts, pa.large_string()))
            edited = signatures(pa.array(edits, pa.large_string()))
            at = [i for i, x in enumerate(held[:-1]) if not x[1]]
            return pa.RecordBatch.from_arrays([
                pa.array([x[2] for x, _ in pairs], held_type), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edits], pa.string()), pa.array([told(own[i]) for i in at], pa.string()), pa.array(list(map(told, edited)), pa.string()),
                pa.array([likeness(own[i], e) for i, e in zip(at, edited, strict=True)], pa.float64()), pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64()),
            ], schema.names)

        for batch in batches:
            held_type = batch.column("doc_id").type
            for part in vec.slices(batch, size=vec.SLICE_BYTES // 2):
                held += zip(*(c.to_pylist() for c in part.columns), strict=True)
                if len(held) > 1:
                    yield worked(held)
                    held = held[-1:]

    return _dealt(rows, common.partitions(docs.sparkSession)).mapInArrow(each, schema)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (a digest of the set), class_id (the smallest doc_id of those that chains of likeness >= threshold connect)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), *T.StructType.fromDDL("fingerprint string, sigs array<long>").fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch):
                own = signatures(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() for x in own], pa.string()), pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))], schema.names)

    rows = common.cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, schema))
    sets = common.cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.first("sigs").alias("sigs")).withColumn("node", F.xxhash64("fingerprint")).withColumn("n", F.size("sigs")))
    step = -math.log(threshold)
    length = F.floor(F.log(F.greatest("n", F.lit(1))) / F.lit(step) + 1e-9).cast("int")
    holds = sets.where("n > 0").select("node", "n", length.alias("part"), F.explode("sigs").alias("sig"))
    often = holds.groupBy("sig").agg(F.count("*").alias("df"))
    ranked = holds.join(often, "sig").where("df > 1").select("node", "n", "part", F.struct("df", "sig").alias("s"))  # what only one set holds finds nothing
    lone = sets.select("node", "n").join(ranked.groupBy("node").agg(F.sort_array(F.collect_list("s")).alias("shared"), F.first("part").alias("part")), "node")
    # of the first n - ceil(t n) + 1, those that only this set holds come first and are left out
    front = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * threshold).cast("int") + 1 - (F.col("n") - F.size("shared")))
    probe = lone.select("node", "n", "part", F.explode(F.slice("shared", 1, front)).alias("s")).select("node", "n", "part", F.col("s.sig").alias("sig"))
    # within a list of sets with a common rare signature, each is compared with its neighbours in order of length
    a = probe.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("part"), "sig")
    b = probe.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("part"), "sig")
    pairs = a.join(b, ["part", "sig"]).where("(na < nb or (na = nb and a < b))").where(F.col("na") >= F.col("nb") * threshold).select("a", "b").distinct()
    full = sets.select("node", "sigs")
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("sigs").alias("sa")), "a").join(full.select(F.col("node").alias("b"), F.col("sigs").alias("sb")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = batch.column("sa"), batch.column("sb")
            near = [likeness(sa[i].values.to_numpy().view(np.uint64), sb[i].values.to_numpy().view(np.uint64), threshold) >= threshold for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(near)), batch.column("b").filter(pa.array(near))], ["a", "b"])

    links = both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")
    roots = graph.components(links)
    linked = sets.select("node", "least").join(roots, "node")
    named = linked.groupBy("root").agg(F.min("least").alias("class_id"))
    of_set = sets.select("fingerprint", "node", "least").join(roots, "node", "left").join(named, "root", "left").select("fingerprint", F.coalesce("class_id", "least").alias("class_id"))
    return rows.select("doc_id", "fingerprint").join(of_set, "fingerprint").select("doc_id", "fingerprint", "class_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return against_edits(common.table(spark, sf_dir, "documents"))
