"""Number handling under ANSI mode: tolerant parsing, finiteness, safe arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

INFINITY = float("inf")


def as_number(value: Column) -> Column:
    """Double or null: text that is no number and NaN both become null, infinities stay."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def finite(value: Column) -> Column:
    """The value where it is a finite number, else null."""
    number = as_number(value)
    return F.when(F.abs(number) < F.lit(INFINITY), number)


def clip(value: Column, low: float, high: float) -> Column:
    """The value moved into [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def fold_sum(values: Column) -> Column:
    """Sum of an array in its given order, so that the result has the same bits every time."""
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def values_by_name(df: DataFrame, keys: list[str], name_col: str, value_col: str) -> DataFrame:
    """Per key the array ``values`` of structs ``(name, value)`` in the order of their names.

    A key with two rows of one name is an error. The state of a key is one slot for each of its rows, whatever the
    number of names, and the order is fixed, so that sums over it repeat to the bit.
    """
    pair = F.struct(F.col(name_col).alias("name"), as_number(F.col(value_col)).alias("value"))
    listed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(pair)).alias("values"))
    names = F.transform("values", lambda v: v["name"])
    twice = F.size(F.array_distinct(names)) < F.size(names)
    told = F.raise_error(F.lit(f"several values for one {name_col} of the same {', '.join(keys)}"))
    return listed.select(*keys, F.when(twice, told).otherwise(F.col("values")).alias("values"))
