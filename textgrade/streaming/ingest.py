"""Take in new pool documents as they arrive: the batch pool rules on a stream."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, functions as F, types as T

from textgrade.functions.text import text_key
from textgrade.operators.quality import drop_repeats, keep_in_band
from textgrade.plans.corpus import (
    CHUNKS_PER_DOCUMENT,
    POOL_MAX_TOKENS,
    POOL_MIN_TOKENS,
    chunk_documents,
)
from textgrade.schema import CANONICAL, COLUMNS, canonical
from textgrade.sources.settled import settle

DOCUMENTS = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("doc_index", T.LongType()),
        T.StructField("domain", T.StringType()),
        T.StructField("text", T.StringType()),
    ]
)


# The pool keeps each text's key, so that a batch compares keys and reads no earlier texts. Rows lie in folders by
# the beginning of the key, so that a batch reads the keys of its own folders only.
PREFIX = 1
STORED = T.StructType(
    [
        *CANONICAL.fields,
        T.StructField("text_key", T.StringType()),
        T.StructField("batch", T.LongType()),
        T.StructField("prefix", T.StringType()),
    ]
)


def ingest_pool(
    spark: SparkSession,
    documents: str,
    pool: str,
    checkpoint: str,
    min_tokens: int = POOL_MIN_TOKENS,
    max_tokens: int = POOL_MAX_TOKENS,
    max_chunks_per_doc: int = CHUNKS_PER_DOCUMENT,
    max_files: int = 1000,
) -> None:
    """Process every document file not seen before, then stop.

    Windowing and filters need no state. Each batch is freed of repeats in itself and of texts the
    pool already holds, and lands in its own folder, so a repeated batch replaces its own rows.
    A new checkpoint numbers its batches from 0 and would replace rows of a pool that has some: refused.
    """
    if not _exists(spark.read.format("text"), f"{checkpoint}/offsets") and _exists(spark.read.format("parquet"), pool):
        raise ValueError(f"{pool} holds rows already; go on with the checkpoint it was filled with")
    stream = (
        spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", max_files).parquet(documents)
    )
    chunks = keep_in_band(
        chunk_documents(stream, min_tokens, max_tokens, max_chunks_per_doc), min_tokens, max_tokens
    )

    def land(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("text_key", text_key("text"))
        chunked = settle(keyed.withColumn("prefix", key_prefix(F.col("text_key"))))
        fresh = drop_repeats(chunked, key=F.col("text_key"))
        if batch_id > 0:
            fresh = fresh.join(earlier_keys(spark, pool, chunked, batch_id), ["corpus", "text_key"], "left_anti")
        rows = fresh.select(*COLUMNS, "text_key", "prefix").repartition("prefix")
        rows.write.mode("overwrite").partitionBy("prefix").parquet(f"{pool}/batch={batch_id}")

    query = (
        chunks.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def key_prefix(key: Column) -> Column:
    """Folder of a key, which is a hash: its first digits."""
    return F.substring(key, 1, PREFIX)


def earlier_keys(spark: SparkSession, pool: str, fresh: DataFrame, batch_id: int) -> DataFrame:
    """``corpus, text_key`` of earlier batches in the folders that ``fresh`` has rows for, at most 16 names."""
    folders = [r["prefix"] for r in fresh.select("prefix").distinct().collect()]
    own = F.col("prefix").isin(folders) | F.col("prefix").isNull()  # null: of a pool without these folders
    held = _stored(spark, pool).where((F.col("batch") < batch_id) & own)
    return held.select("corpus", "text_key")


def _exists(reader: DataFrameReader, path: str) -> bool:
    """Does ``path`` hold anything the reader can read?"""
    try:
        return not reader.load(path).isEmpty()
    except AnalysisException:
        return False


def _stored(spark: SparkSession, pool: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(pool)


def read_pool(spark: SparkSession, pool: str) -> DataFrame:
    """The pool so far, as canonical rows."""
    return canonical(_stored(spark, pool))
