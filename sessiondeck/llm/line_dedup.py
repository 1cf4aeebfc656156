"""Line dedup: drop the lines that many documents share.

Lines are normalised, hashed and exploded; documents are counted for each hash; lines over the threshold go; what is
left is put together by position. Only DataFrame functions. The exploded rows carry an id, a position and a hash, not the
line, so the text itself is shuffled once, when the flags meet it.

Defined cases: a null or empty text is one empty line and stays as it is; lines whose key is shorter than
`min_key_chars` are never dropped; a line repeated within a document counts that document once; each row is one document, or with
`by_id`, as the query and the pipeline have it and as the SQL counts, all rows of a doc_id are, and those of a null doc_id
none; rows that repeat in every column get the same result each; a null doc_id is an id like others; columns of the input
besides text stay, and names that this operator needs for itself are prefixed with `_ld_`.
Two keys with equal 64-bit hashes count as one: for d shared keys, the odds of a line being dropped wrongly are d / 2**64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import common

SPACES = " \t\n\x0b\x0c\r"
MIN_DOCUMENTS, MIN_KEY_CHARS = 10, 1


def line_keys(text: Column) -> Column:
    """The normalised lines of a text."""
    return F.transform(F.split(common.ascii_lower(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))


def drop_common_lines(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, min_key_chars: int = MIN_KEY_CHARS, text: str = "text", doc_id: str = "doc_id", by_id: bool = False) -> DataFrame:
    """The rows of docs with `text` as it is left, and `n_lines` and `n_dropped` besides (replacing columns so named)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hashed = F.transform(line_keys(whole), lambda x: F.when(F.char_length(x) >= min_key_chars, F.xxhash64(x)))  # null: always kept
    keyed = docs.select(F.col(doc_id).alias("_ld_id"), F.xxhash64(whole).alias("_ld_text"), hashed.alias("_ld_hashes"))
    held = keyed.select("_ld_id", F.explode(F.array_distinct("_ld_hashes")).alias("_ld_hash")).where(F.col("_ld_hash").isNotNull())
    if by_id:
        held = held.where(F.col("_ld_id").isNotNull()).distinct()
    shared = (
        held.groupBy("_ld_hash").agg(F.count("*").alias("_ld_n")).where(F.col("_ld_n") >= min_documents)
        .select("_ld_hash")
    )
    shared = common.cut(shared)  # few rows; read from there, a line that very many documents hold can be dealt over several tasks of the join
    lines = keyed.select("_ld_id", "_ld_text", F.posexplode("_ld_hashes").alias("_ld_pos", "_ld_hash")).where(F.col("_ld_hash").isNotNull())
    gone = (
        lines.join(shared, "_ld_hash", "left_semi")
        .groupBy("_ld_id", "_ld_text").agg(F.array_sort(F.collect_set("_ld_pos")).alias("_ld_gone"))
    )
    left = docs.withColumn("_ld_text", F.xxhash64(whole))
    joined = left.join(gone.withColumnRenamed("_ld_text", "_ld_text2"), left[doc_id].eqNullSafe(F.col("_ld_id")) & (F.col("_ld_text") == F.col("_ld_text2")), "left")
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    # a line's flag: looked up by position in an array with one entry for each line, so the work is linear in the lines
    none = F.array().cast("array<int>")
    gone_at = F.coalesce(F.col("_ld_gone"), none)
    flags = F.split(F.concat_ws("", _marks(gone_at, F.size(split))), "")
    kept = F.when(F.col("_ld_gone").isNull(), F.col(text)).otherwise(F.array_join(F.filter(F.arrays_zip(split.alias("l"), flags.alias("f")), lambda x: x["f"] == "1")["l"], "\n"))
    return joined.select(*[F.col(c) if c != text else kept.alias(text) for c in docs.columns if c not in ("n_lines", "n_dropped")], F.size(split).cast("long").alias("n_lines"), F.size(gone_at).cast("long").alias("n_dropped"))


def _marks(gone: Column, n: Column) -> Column:
    """Runs of 1 for the lines between dropped positions and 0 for the dropped ones, from the sorted positions."""
    padded = F.concat(F.array(F.lit(-1)), gone, F.array(n))
    runs = F.zip_with(F.slice(padded, 1, F.size(padded) - 1), F.slice(padded, 2, F.size(padded) - 1), lambda a, b: F.repeat(F.lit("1"), b - a - 1))
    return F.array(F.array_join(runs, "0"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_common_lines(docs, by_id=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         trim(translate(u.line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS pos) u
), shared AS (
  SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT l.*, s.k IS NOT NULL AS gone FROM lines l LEFT JOIN shared s ON l.k = s.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
