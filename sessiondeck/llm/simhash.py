"""SimHash near-dedup with vantage-point trees.

A fingerprint has 64 bits; two within `threshold` differing bits are linked. With one tree over all bits the distances of
unlike fingerprints crowd around 32, and at each node the boundary of width 3 holds some 29 % of them. So the bits are cut
into two halves: linked fingerprints differ by `threshold // 2` bits at most in one of them. Each half has a vantage-point tree
over the distances of that half's bits, in which the radius sought is 1 and the boundary holds 14 %. A node has a vantage
point, one of its own fingerprints, and the median of their distances to it as radius r: what is at r or nearer goes inside,
the rest outside, and by the triangle inequality a fingerprint outside has a partner inside only if it is at r + 1 at most:
those are guests of the inside too. All other branches are pruned, and no pair is lost.

The upper levels are built on the driver from a sample of at most `SAMPLE` fingerprints, down to shards of an estimated
`SHARD_ROWS` (more where that would make over `SAMPLE / 64` of them), and sent to all tasks: 20 bytes for each shard. Every
fingerprint goes down this tree and to each shard that it reaches, guests included. A task then builds the lower levels of a
shard from its own fingerprints, down to leaves of `LEAF_ROWS`, in which all distances over all bits are computed. So the
sample decides on the shards' sizes only. A leaf that no vantage point divides holds fingerprints that are nearly equal in that half:
there each member is expanded once, against those that aren't reached yet. Each member is linked to the smallest one that a
chain of near ones connects it with there, so that links stay linear in the members. Links become components by rounds over the edge list.
Of random fingerprints, 57 % go to each child, so the comparisons grow as N ** 1.23, where all pairs grow as N ** 2.

Defined cases: a null or empty text, or one without words, has fingerprint zero and links like any other; equal
fingerprints are one node; rows that repeat get the same component each; a null doc_id can be in a component but doesn't
name one unless all in it are null; other columns stay (but fingerprint and component_id, which are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from . import common, graph, vec

SHINGLE, SEED, THRESHOLD, BITS = 3, 42, 3, 64
HALVES = 2
SAMPLE, SHARD_ROWS, LEAF_ROWS = 1 << 17, 1 << 15, 48


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and exactly the space and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    n = len(words) - k + 1
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), "<u8", n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 14):
        counts += np.unpackbits(h[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without `text`, with `fp` long: the fingerprint's bits."""
    rest = [c for c in docs.columns if c not in (text, "fp")]
    schema = T.StructType([*(docs.schema[c] for c in rest), T.StructField("fp", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(rest))
            found = np.array([fingerprint(texts[i].as_py()) for i in range(len(texts))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(found.view(np.int64))], schema.names)

    return docs.select(*rest, text).mapInArrow(each, schema)


def hex_of(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


class Tree(NamedTuple):
    """Inner nodes; a child below 0 is the shard of number -1 - child."""

    mask: int  # the half's bits
    reach: int  # how far partners are in these bits
    point: np.ndarray
    radius: np.ndarray
    inside: np.ndarray
    outside: np.ndarray


def halves(threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """Mask and reach of each half."""
    cuts = [BITS * i // HALVES for i in range(HALVES + 1)]
    return [((1 << hi) - (1 << lo), threshold // HALVES) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def divide(fp: np.ndarray, mask: int, reach: int) -> tuple[int, int, np.ndarray, np.ndarray] | None:
    """Vantage point, radius, and who goes inside (guests too) and outside; None if no few points divide them."""
    bits = fp & np.uint64(mask)
    for k in range(3):  # the first, the middle and the last one
        v = bits[(len(fp) - 1) * k // 2]
        d = np.bitwise_count(bits ^ v).astype(np.int64)
        near = np.bincount(d, minlength=65)
        up_to = np.cumsum(near)
        guests = up_to[np.minimum(np.arange(65) + reach, 64)]
        r = int(np.argmin(np.maximum(guests, len(fp) - up_to)))  # the smaller the larger child, the better; about the median
        if max(int(guests[r]), len(fp) - int(up_to[r])) <= 0.95 * len(fp):
            return int(v), r, d <= r + reach, d > r
    return None


def build(sample: np.ndarray, mask: int, reach: int, rows: float) -> Tree:
    """The upper levels, down to shards of `rows` of the sample."""
    nodes: list[list[int]] = []
    shards, stack = 0, [(sample, -1, 0)]
    while stack:
        own, parent, side = stack.pop()
        cut = divide(own, mask, reach) if len(own) > rows else None
        here = len(nodes) if cut else -1 - shards
        if parent >= 0:
            nodes[parent][side] = here
        if cut:
            v, r, inside, outside = cut
            nodes.append([v, r, 0, 0])
            stack += [(own[inside], here, 2), (own[outside], here, 3)]
        else:
            shards += 1
    columns = list(zip(*nodes, strict=True)) or [()] * 4
    return Tree(mask, reach, np.array(columns[0], np.uint64), *(np.array(x, np.int64) for x in columns[1:]))


def shards_of(tree: Tree, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Who goes where: places in fp, and shards; a place for each shard that it reaches."""
    at, node, out = np.arange(len(fp)), np.zeros(len(fp), np.int64), []
    if not len(tree.point):
        return at, node
    while len(at):
        d = np.bitwise_count((fp[at] & np.uint64(tree.mask)) ^ tree.point[node]).astype(np.int64)
        inside, outside = d <= tree.radius[node] + tree.reach, d > tree.radius[node]
        at, node = np.concatenate([at[inside], at[outside]]), np.concatenate([tree.inside[node[inside]], tree.outside[node[outside]]])
        done = node < 0
        out.append((at[done], -1 - node[done]))
        at, node = at[~done], node[~done]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def leaves(fp: np.ndarray, mask: int, reach: int, rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """The lower levels of one shard: leaf and fingerprint, sorted by leaf, guests included."""
    out, stack = [], [fp]
    while stack:
        own = stack.pop()
        cut = divide(own, mask, reach) if len(own) > rows else None
        if cut:
            stack += [own[cut[2]], own[cut[3]]]
        else:
            out.append(own)
    return np.repeat(np.arange(len(out)), [len(x) for x in out]), np.concatenate([fp[:0], *out])


def leaf_edges(leaf: np.ndarray, fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, within each leaf (rows sorted by leaf), all fingerprints that a chain of near ones connects: from each to the first in its chain."""
    n = len(leaf)
    if not n:
        return fp[:0], fp[:0]
    begin = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    size = np.diff(np.concatenate([begin, [n]]))
    row_size = np.repeat(size, size)
    label = np.arange(n)
    near_a, near_b = [], []
    for k in range(1, min(LEAF_ROWS, int(size.max()))):
        i = np.flatnonzero((leaf[k:] == leaf[:-k]) & (row_size[k:] <= LEAF_ROWS))
        i = i[np.bitwise_count(fp[i] ^ fp[i + k]) <= threshold]
        near_a.append(i)
        near_b.append(i + k)
    if near_a:
        a, b = np.concatenate(near_a), np.concatenate(near_b)
        while len(a):
            before = label.copy()
            np.minimum.at(label, b, label[a])
            np.minimum.at(label, a, label[b])
            label = label[label]
            if (before == label).all():
                break
    for s, m in zip(begin[size > LEAF_ROWS], size[size > LEAF_ROWS], strict=True):
        own, left = fp[s : s + m], np.arange(m)
        while len(left):  # what isn't reached yet; each member is expanded once, against those only
            root, queue, left = left[0], [left[0]], left[1:]
            while queue and len(left):
                hit = np.bitwise_count(own[left] ^ own[queue.pop()]) <= threshold
                if hit.any():
                    label[s + left[hit]] = s + root
                    queue.extend(left[hit].tolist())
                    left = left[~hit]
    linked = np.flatnonzero(label != np.arange(n))
    return fp[linked], fp[label[linked]]


def links(nodes: DataFrame, threshold: int = THRESHOLD, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """a, b: edges that connect what chains of near fingerprints connect. nodes: distinct `fp`, read several times."""
    spark, n = nodes.sparkSession, nodes.count()
    place = F.pmod(F.xxhash64("fp", F.lit("sample")), F.lit(1 << 30))
    drawn = nodes.where(place < F.lit(int((1 << 30) * min(1.0, SAMPLE / 2 / max(n, 1))))).select("fp").orderBy(place, "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    target = max(shard_rows, n // (SAMPLE // 64)) * len(drawn) / max(n, 1)
    trees = [build(drawn, mask, reach, target) for mask, reach in halves(threshold)]
    sent = spark.sparkContext.broadcast(trees)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for k, tree in enumerate(sent.value):
                at, shard = shards_of(tree, fp)
                yield pa.RecordBatch.from_arrays([pa.array(shard * HALVES + k), pa.array(fp[at].view(np.int64))], ["shard", "fp"])

    dealt = nodes.select("fp").mapInArrow(deal, "shard long, fp long").repartition(common.partitions(spark), "shard").sortWithinPartitions("shard", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_s, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def told(s: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.diff(s, prepend=-1, append=-1)) if len(s) else []
            for x, y in zip(edge, edge[1:], strict=False):
                mask, reach = halves(threshold)[int(s[x]) % HALVES]
                a, b = leaf_edges(*leaves(f[x:y], mask, reach), threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held_s = np.concatenate([held_s, batch.column(0).to_numpy()])
            held_f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(held_s, held_s[-1])) if len(held_s) else 0
            if whole:
                yield from told(held_s[:whole], held_f[:whole])
                held_s, held_f = held_s[whole:], held_f[whole:]
        yield from told(held_s, held_f)

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without `text`, with `fingerprint` (hex) and `component_id`."""
    rest = [c for c in docs.columns if c not in (text, "fingerprint", "component_id")]
    rows = common.cut(fingerprints(docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("row"), text), text))
    nodes = common.cut(rows.groupBy("fp").agg(F.min(F.col("row")[doc_id]).alias("least")))
    roots = graph.components(links(nodes.select("fp"), threshold))
    linked = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = nodes.join(linked.select("fp", "root").join(named, "root").select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    of_fp = common.cut(of_fp)  # read from there, the rows of a fingerprint that many documents have can be dealt over several tasks of the join
    return rows.join(of_fp, "fp").select(*[F.col("row")[c].alias(c) for c in rest], hex_of("fp").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
