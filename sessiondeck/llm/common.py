"""Reading tables, cutting lineage and the small rules that all operators share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..shared import shared_dir

#: Rows in an Arrow batch: with whole texts a batch stays at a few MB, in the JVM and in its Python workers.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once and written to the shared folder, so that lost executors cost nothing that is done."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_by(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """cut(), dealt by keys to n partitions, so that groups and joins by these keys read them without a further shuffle.

    Adaptive plans don't tell how their rows lie, so this one isn't.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df.repartition(n, *keys))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def free(spark: SparkSession, wait: float = 0.0) -> None:
    """Lets Spark remove the shuffle files and checkpoints that nothing refers to any more; else they stay until the driver happens to collect its garbage.

    wait: seconds for what the last job still holds, which goes with the job after it.
    """
    gc.collect()
    if wait:
        spark.range(1).count()
    spark._jvm.System.gc()
    if wait:
        time.sleep(wait)
        spark._jvm.System.gc()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """A folder that nothing reads any more, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of doc_id as text, modulo k. A null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; plain lower() does that where a text is ASCII only, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))
