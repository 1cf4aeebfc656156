"""A corpus pipeline: five operators in turn, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of documents. What a stage
gives is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sessiondeck.llm import bpe, common, decontaminate, language_id, line_dedup, simhash


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or no letter) go; the others get the predicted one as `lang`."""
    model = language_id.fit(docs, ~language_id.held_out())
    found = language_id.predict(docs, model).where(F.col("lang_pred") != language_id.UNKNOWN)
    return found.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(c) for c in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go from every text; n_chars follows."""
    left = line_dedup.drop_common_lines(docs, by_id=True)
    return left.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies a row of the smallest doc_id stays, one only; a doc_id in several groups is judged in each.

    Rows without a doc_id go if their group has one that has; else one row of each fingerprint stays.
    """
    named = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"))  # a text lies in one group, so groups never share these
    found = simhash.near_duplicates(docs.select(F.when(F.col("doc_id").isNotNull(), named).alias("doc_id"), "text"))
    first = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id.id").alias("doc_id"), F.col("doc_id.of").alias("_of")).distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).withColumn("_of", F.xxhash64("text")).join(first, ["doc_id", "_of"], "left_semi").dropDuplicates(["doc_id", "_of"]).select(*docs.columns)
    nameless = docs.where(F.col("doc_id").isNull()).withColumn("_text", F.col("text"))
    prints = simhash.fingerprints(nameless, "_text").withColumn("_print", simhash.hex_of("fp"))
    alone = found.where(F.col("component_id").isNull()).select(F.col("fingerprint").alias("_print")).distinct()
    return kept.unionByName(prints.join(alone, "_print", "left_semi").dropDuplicates(["_print"]).select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token counts, and digests of their tokens and of what these decode to."""
    return bpe.digests(docs)


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("simhash", drop_near_copies), ("decontamination", drop_leaks), ("bpe", encode)]

#: SQL expresses neither the kernels' predictions nor the tokenizer's merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's input goes as soon as its output is written; only the last one's stays, as its rows are yet to be read."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = common.fresh_path(spark, f"pipeline-{name}")
        out.write.parquet(path)
        if before:
            common.remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
