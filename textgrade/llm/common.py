"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words are runs of anything but space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: A side is broadcast only if it was counted and measured to have at most so many rows and bytes (of its files).
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def broadcast_if_small(settled: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a written table for broadcast if it is small in rows and, by the statistics of its files, in bytes.

    Beyond that it stays as it is and Spark joins by shuffle, splitting skewed partitions.
    """
    size = int(str(settled._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(settled) if size <= BROADCAST_BYTES and settled.count() <= rows else settled


def same(left, right):
    """Equality that holds for two nulls as well."""
    return left.eqNullSafe(right)
