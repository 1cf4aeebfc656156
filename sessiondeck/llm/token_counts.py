"""Token counts through a digest cache.

A text is normalised (null to empty; nothing more, as every byte counts for a byte-level tokenizer) and digested. The
digests, with the digest of the tokenizer file, are joined to the stored counts; of those that miss, each distinct text is
encoded once, and its count is appended to the cache, a folder of Parquet files. All rows then take their counts from the
cache by digest. Digests are asked first, so with a full cache no text is shuffled: up to `BROADCAST_MISSES` missing digests
are sent to where the texts are, and only those texts move; of more, all texts do, once, without their copies.

Defined cases: null and empty texts have 0 bytes and 0 tokens; repeated rows repeat; other columns of the input are kept
(but n_bytes, n_tokens and over_limit, which are replaced); an empty table gives an empty table. Counts that two runs
append at once are equal, and reading takes one of them.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common, vec

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 1024
BROADCAST_MISSES = 200_000
CACHE_SCHEMA = "tokenizer string, digest string, n_tokens long"


def tokenizer_digest(name: str) -> str:
    with open(public_tokenizers.path(name), "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_names() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, the rest from U+0100 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def _as_ranks(spec: dict) -> dict[bytes, int] | None:
    """The vocabulary as ranks, if merges are made in the order of ids and the file asks for nothing but that."""
    model, added = spec["model"], {x["content"] for x in spec["added_tokens"]}
    before = spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and spec.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain or any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or not x.get("special") for x in spec["added_tokens"]):
        return None
    names, vocab = _byte_names(), {k: v for k, v in model["vocab"].items() if k not in added}
    if any(c not in names for k in vocab for c in k):
        return None
    made = [vocab.get("".join(m if isinstance(m, list) else m.split(" ", 1)), -1) for m in model["merges"]]
    if made != sorted(made) or made[:1] == [-1] or len(vocab) != 256 + len(made):
        return None
    return {bytes(names[c] for c in k): v for k, v in vocab.items()}


@lru_cache(maxsize=4)
def counter(name: str) -> Callable[[list[str]], list[int]]:
    """Counts as the file's own library gives them. A byte-level .json whose merges follow its ids is run as ranks, with its special tokens, which gives the same ids at some four times the speed."""
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if ranks := _as_ranks(spec):
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda texts: [len(own.encode_to_numpy(x, allowed_special="all")) for x in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return lambda texts: [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA).select("digest", "n_tokens")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, cache: str, tokenizer: str = TOKENIZER, text: str = "text", few: int = BROADCAST_MISSES) -> str:
    """Appends the counts of all texts that the cache lacks. Gives the tokenizer's digest. few: how many missing digests are broadcast."""
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer)
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(whole.alias("text"), F.sha2(whole.cast("binary"), 256).alias("digest"))
    stored = read_cache(spark, cache, version).select("digest")
    missing = common.cut(texts.select("digest").distinct().join(stored, "digest", "left_anti"))
    n = missing.count()
    if not n:
        return version
    if n <= few:
        texts = texts.join(F.broadcast(missing), "digest", "left_semi")
    # copies go before the shuffle, so that a text that many documents hold isn't gathered in one task
    misses = texts.dropDuplicates(["digest"])
    if n > few:
        misses = misses.join(missing, "digest", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch):
                n = counter(tokenizer)(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(n)), part.column("digest"), pa.array(n, pa.int64())], ["tokenizer", "digest", "n_tokens"])

    misses.select("digest", "text").mapInArrow(count, CACHE_SCHEMA).write.mode("append").parquet(cache)
    return version


def count_tokens(docs: DataFrame, cache: str, tokenizer: str = TOKENIZER, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """docs without `text`, with `n_bytes`, `n_tokens` and `over_limit`."""
    version = fill_cache(docs, cache, tokenizer, text)
    rest = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens", "over_limit")]
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(F.lit(0).alias("_"), *rest).alias("row"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole.cast("binary"), 256).alias("digest"))
    counts = common.cut(read_cache(docs.sparkSession, cache, version))  # read from there, rows of a text that many documents hold can be dealt over several tasks of the join
    return rows.join(counts, "digest", "left").select(*[F.col("row")[c].alias(c) for c in rest], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of a table's path: a second call over the same path encodes nothing."""
    cache = f"{common.shared_dir(spark)}/token_counts/{hashlib.md5(sf_dir.encode()).hexdigest()}"
    return count_tokens(common.table(spark, sf_dir, "documents").select("doc_id", "text"), cache)
