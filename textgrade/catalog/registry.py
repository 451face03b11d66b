"""Named queries over the given tables and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; without ``sql`` only its rows can be checked."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), 6)


def rounded(df: DataFrame) -> DataFrame:
    """Every double column at six decimals."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
