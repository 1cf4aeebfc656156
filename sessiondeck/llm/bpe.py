"""Byte-level BPE encoding and decoding with a rank file.

A text of up to `chunk_chars` characters is one chunk, encoded where it is read. A longer one is cut into chunks that
overlap by `overlap` characters, dealt over the cluster and pre-tokenised in parallel, each from its own start. Where two
neighbours name the same pre-token boundary inside their overlap they have resynchronised: from one position the pattern
always matches alike, so all later boundaries are equal too. The chunks are stitched at the first such boundary (after a
letter or digit), and the pieces between stitches are encoded. Where two neighbours don't meet (a pre-token longer than the
overlap), the chunks become one piece, up to the next boundary between a letter or digit and a space, which is a boundary in
any reading, since no match of the pattern holds a non-space before a space. So nothing is cut short, and only a single huge pre-token makes a
huge piece. Decoding concatenates the tokens' raw bytes.

Defined cases: a null or empty text has no tokens and decodes to no bytes; each row is encoded by itself, so repeated
rows repeat; other columns of the input are kept (but `ids`, which is replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from . import common, vec

RANKS = "byte_bpe_multi_50k.tiktoken"
CHUNK_CHARS, OVERLAP = 1 << 16, 1 << 10


@lru_cache(maxsize=4)
def ranks_of(name: str) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(name: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks_of(name), special_tokens={})


@lru_cache(maxsize=4)
def raw_tokens(name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens in a row, and where each id's begin."""
    ranks = ranks_of(name)
    by_id = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        by_id[i] = raw
    return np.frombuffer(b"".join(by_id), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in by_id])])


@lru_cache(maxsize=1)
def pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def ids_of(text: str, ranks: str = RANKS) -> np.ndarray:
    return encoding(ranks).encode_to_numpy(text, disallowed_special=()).astype(np.int32)


def decode_ids(ids: np.ndarray, ranks: str = RANKS) -> bytes:
    raw, at = raw_tokens(ranks)
    if not len(ids):
        return b""
    lengths = at[ids + 1] - at[ids]
    ends = np.cumsum(lengths)
    return raw[np.repeat((at[ids] - (ends - lengths)).astype(np.int64), lengths) + np.arange(ends[-1])].tobytes()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *parts]), pa.int32()))


def chunks(text: str, chunk_chars: int, overlap: int) -> list[tuple[int, str]]:
    """Starts and texts of the overlapping chunks."""
    return [(s, text[s : s + chunk_chars + overlap]) for s in range(0, max(1, len(text)), chunk_chars)]


def edges(start: int, piece: str, chunk_chars: int, overlap: int) -> tuple[list[int], list[int], list[int], list[int]]:
    """Pre-token boundaries of a chunk in its first and last overlap, as positions of the text, and those of them that are boundaries in any reading.

    Only boundaries after a letter or digit count: what is matched before them depends on nothing behind them, while a run
    of spaces is cut by what follows it. What touches the end of the chunk isn't settled and left out.
    """
    found = [m.end() for m in pattern().finditer(piece)]
    while found and found[-1] >= len(piece) - 1:
        found.pop()
    settled = [b for b in found if piece[b - 1].isalnum()]
    zones = [[b for b in settled if b <= overlap], [b for b in settled if b >= chunk_chars]]
    hard = [[start + b for b in zone if piece[b] in " \t\r\n"] for zone in zones]
    return [start + b for b in zones[0]], [start + b for b in zones[1]], hard[0], hard[1]


def stitches(zones: list[tuple[list[int], list[int], list[int], list[int]]]) -> list[int]:
    """For each chunk but the first, where it takes over from its predecessor; -1 where it doesn't and both are one piece."""
    cuts, joined = [], False
    for (_, tail, _, tail_hard), (head, _, head_hard, _) in zip(zones, zones[1:], strict=False):
        both = set(tail_hard) & set(head_hard) if joined else set(tail) & set(head)  # after a chunk that was swallowed, only boundaries of any reading
        cuts.append(min(both, default=-1))
        joined = cuts[-1] < 0
    return cuts


def pieces(parts: list[tuple[int, str]], cuts: list[int]) -> list[str]:
    """The texts between stitches; a text's chunks by start, and stitches()."""
    out, begin, held = [], 0, ""
    for k, (start, piece) in enumerate(parts):
        held += piece[begin + len(held) - start :]
        last = k == len(parts) - 1
        if last or cuts[k] >= 0:
            end = begin + len(held) if last else cuts[k]
            out.append(held[: end - begin])
            begin, held = end, ""
    return out


def encode(docs: DataFrame, ranks: str = RANKS, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP, text: str = "text", decoded: bool = False) -> DataFrame:
    """docs without `text`, with `ids` array<int>. decoded: and with `decoded` binary, what the ids decode to, made beside them so that they needn't be sent again."""
    if not 2 <= overlap <= chunk_chars:
        raise ValueError("overlap must be from 2 to chunk_chars")
    rest = [c for c in docs.columns if c not in (text, "ids", *["decoded"] * decoded)]
    docs = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row_type = docs.schema["row"].dataType.simpleString()
    names = ["row", "ids", *["decoded"] * decoded]
    out_schema = f"row {row_type}, ids array<int>" + ", decoded binary" * decoded

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch):
                found = [ids_of(x, ranks) for x in part.column(1).to_pylist()]
                back = [pa.array([decode_ids(x, ranks) for x in found], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(found), *back], names)

    short = docs.where(F.char_length("text") <= chunk_chars).mapInArrow(whole, out_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 36
        for batch in batches:
            for i, x in enumerate(batch.column(1).to_pylist()):
                rid += 1
                for k, (s, piece) in enumerate(chunks(x, chunk_chars, overlap)):
                    row = batch.column(0).slice(i, 1) if not k else pa.nulls(1, batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), pa.array([k], pa.int32()), pa.array([s], pa.int64()), pa.array([piece], pa.string()), row], ["rid", "k", "start", "piece", "row"])

    n = common.partitions(docs.sparkSession)
    dealt = docs.where(F.char_length("text") > chunk_chars).mapInArrow(cut, f"rid long, k int, start long, piece string, row {row_type}")
    dealt = common.cut_by(dealt, n, "rid", "k")  # written once: a row's number is made in the reading task, so its chunks must never be made anew in another order
    zone = "array<long>"

    def pretokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [edges(s, p, chunk_chars, overlap) for s, p in zip(batch.column("start").to_pylist(), batch.column("piece").to_pylist(), strict=True)]
            columns = [pa.array([x[j] for x in found], pa.list_(pa.int64())) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("k"), *columns], ["rid", "k", "head", "tail", "head_hard", "tail_hard"])

    zones = dealt.select("rid", "k", "start", "piece").mapInArrow(pretokenise, f"rid long, k int, head {zone}, tail {zone}, head_hard {zone}, tail_hard {zone}")

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        cuts = stitches(list(zip(pdf["head"], pdf["tail"], pdf["head_hard"], pdf["tail_hard"], strict=True)))
        begins = [0, *cuts]
        group, groups = 0, []
        for k, b in enumerate(begins):
            group = k if b >= 0 else group
            groups.append(group)
        return pd.DataFrame({"rid": pdf["rid"].to_numpy(), "k": pdf["k"].to_numpy(), "piece_no": groups, "begin": begins, "end": [*cuts, -1]})

    joints = zones.groupBy("rid").applyInPandas(stitch, "rid long, k int, piece_no int, begin long, end long")

    def encode_piece(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        begin, held = int(pdf["begin"].iloc[0]), ""
        for s, p in zip(pdf["start"], pdf["piece"], strict=True):
            held += p[begin + len(held) - s :]
        end = int(pdf["end"].iloc[-1])
        ids = ids_of(held[: end - begin] if end >= 0 else held, ranks)
        return pd.DataFrame({"rid": pdf["rid"].iloc[:1], "piece_no": pdf["piece_no"].iloc[:1], "part": [ids]})

    encoded = dealt.select("rid", "k", "start", "piece").join(joints, ["rid", "k"]).groupBy("rid", "piece_no").applyInPandas(encode_piece, "rid long, piece_no int, part array<int>")
    gathered = encoded.groupBy("rid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "part"))), lambda x: x["part"])).alias("ids"))
    long = dealt.where(F.col("k") == 0).select("rid", "row").join(gathered, "rid").select("row", "ids")
    long = decode(long.withColumn("kept", F.col("ids")), ranks, "kept") if decoded else long
    return short.unionByName(long).select(*[F.col("row")[c].alias(c) for c in rest], *names[1:])


def decode(encoded: DataFrame, ranks: str = RANKS, ids: str = "ids") -> DataFrame:
    """encoded without the column of ids, with `decoded` binary (replacing a column so named)."""
    rest = [c for c in encoded.columns if c not in (ids, "decoded")]
    schema = T.StructType([*(encoded.schema[c] for c in rest), T.StructField("decoded", T.BinaryType())])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(rest))
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            out = [decode_ids(flat[at[i] : at[i + 1]].astype(np.int64), ranks) for i in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(out, pa.binary())], [*rest, "decoded"])

    return encoded.select(*rest, ids).mapInArrow(whole, schema)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of documents."""
    found = encode(docs.select("doc_id", "text"), decoded=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
