"""Write an intermediate table once so that every later branch reads the same rows.

Needed where a plan uses computed numbers as join keys, or a costly input several times: a repeated
computation may add doubles in another order and miss its own key. The table lies in the shared
folder named by ``spark.checkpoint.dir``; losing an executor then costs no recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local session without it."""
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="textgrade-")
    return _local_folder


def spread(df: DataFrame) -> DataFrame:
    """Cut rows into at least one partition per core where the input has fewer.

    For work that costs much more than moving its rows, over few or unsplittable files. An input
    with enough splits stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def settle(df: DataFrame, spread_by: str | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared folder and read it back.

    With ``spread_by`` the table gets one file per core, for small tables that much is done with.
    """
    spark = df.sparkSession
    if spread_by is not None:
        df = df.repartition(spark.sparkContext.defaultParallelism, spread_by)
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a Python worker is sent at a time where they are whole texts: some MB, in the worker and outside the JVM's heap.
TEXT_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = TEXT_ROWS) -> Iterator[None]:
    """Smaller Arrow batches for what is written inside; the session's own value is back afterwards."""
    given = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(rows, int(given)) if int(given) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, given)


def settle_texts(df: DataFrame) -> DataFrame:
    """``settle`` for a table that Python workers make of whole texts."""
    with few_rows_a_batch(df.sparkSession):
        return settle(df)


#: Rows, and bytes of files, up to which a written table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20


def is_small(settled: DataFrame) -> bool:
    """Whether a written table of narrow rows was measured to be small enough for every task to hold."""
    size = int(str(settled._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= BROADCAST_BYTES and settled.count() <= BROADCAST_ROWS
