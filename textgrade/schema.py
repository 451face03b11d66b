"""The one table layout every corpus is brought into, and its contract checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textgrade.functions.numbers import as_number
from textgrade.functions.text import token_count

CANONICAL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("corpus", T.StringType()),
        T.StructField("native_label", T.DoubleType()),
        T.StructField("native_scale", T.StringType()),
        T.StructField("harmonized_difficulty", T.DoubleType()),
        T.StructField("mapping_method", T.StringType()),
        T.StructField("mapping_confidence", T.DoubleType()),
        T.StructField("std_error", T.DoubleType()),
        T.StructField("format_type", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("length_tokens", T.LongType()),
        T.StructField("license", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("is_pseudo", T.BooleanType()),
    ]
)
COLUMNS = CANONICAL.fieldNames()

# The split names a table may hold.
SPLITS = ("unassigned", "train", "val", "gold_test", "ood_corpus", "ood_format", "unlabeled")

# What a row gets where its source says nothing.
DEFAULTS = {
    "mapping_method": "none",
    "format_type": "prose",
    "language": "en",
    "split": "unassigned",
}

# Difficulties outside this band are reported as errors.
DIFFICULTY_BAND = (-0.5, 1.5)


def _whole_number(value: Column) -> Column:
    number = as_number(value)
    return (
        F.when(number.isNull(), F.lit(None).cast("long"))
        .when(number == F.floor(number), number.cast("long"))
        .otherwise(F.raise_error(F.lit("length_tokens must be a whole number")).cast("long"))
    )


def coerce(df: DataFrame) -> DataFrame:
    """Exactly the canonical columns, in order and typed; whatever is no number becomes null."""
    have = dict(df.dtypes)
    out = []
    for field in CANONICAL:
        name = field.name
        if name not in have:
            value = F.lit(None)
            value = F.lit(False) if name == "is_pseudo" else value.cast(field.dataType)
        elif have[name] in ("bigint", "int", "boolean") and name in ("length_tokens", "is_pseudo"):
            # Already typed: parsing again would repeat the expression behind the column.
            value = F.col(name).cast(field.dataType)
            value = F.coalesce(value, F.lit(False)) if name == "is_pseudo" else value
        elif isinstance(field.dataType, T.DoubleType):
            value = as_number(F.col(name))
        elif name == "length_tokens":
            value = _whole_number(F.col(name))
        elif name == "is_pseudo":
            value = F.coalesce(F.col(name).try_cast("boolean"), F.lit(False))
        else:
            value = F.col(name).cast(field.dataType)
        out.append(value.alias(name))
    return df.select(*out)


def with_defaults(df: DataFrame) -> DataFrame:
    """Canonical rows from partial ones: defaults filled in, token count taken from the text."""
    filled = coerce(df)
    return filled.select(
        *[
            F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c)
            if c in DEFAULTS
            else F.coalesce(F.col(c), token_count("text")).alias(c)
            if c == "length_tokens"
            else F.col(c)
            for c in COLUMNS
        ]
    )


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Hand-made rows (tests, small manual additions) as a canonical table."""
    tuples = [tuple(row.get(c) for c in COLUMNS) for row in rows]
    return with_defaults(spark.createDataFrame(tuples, CANONICAL))


def canonical(df: DataFrame) -> DataFrame:
    """The canonical columns only, as written by every sink."""
    return df.select(*COLUMNS)


def _issue(name: str, n: Column, detail: Column | None = None) -> list[Column]:
    detail = F.lit(None).cast("string") if detail is None else detail
    return [F.lit(name).alias("issue"), n.cast("long").alias("n"), detail.alias("detail")]


def validate(df: DataFrame, strict: bool = False) -> DataFrame:
    """Contract violations as rows ``(issue, n, detail)``; none means the table is clean.

    ``unknown_split`` gives one row per offending value. ``strict`` runs the check at once and
    raises, naming a handful of the issues.
    """
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        issues = df.sparkSession.range(len(missing)).select(
            *_issue(
                "missing_column",
                F.lit(1),
                F.element_at(F.array(*[F.lit(c) for c in missing]), (F.col("id") + 1).cast("int")),
            )
        )
    else:
        difficulty = as_number(F.col("harmonized_difficulty"))
        low, high = DIFFICULTY_BAND
        odd = F.when(~F.col("split").isin(*SPLITS), F.col("split"))
        counted = df.groupBy(odd.alias("odd")).agg(
            F.count_if(F.col("id").isNull() | F.col("text").isNull()).alias("nulls"),
            F.count_if((difficulty < low) | (difficulty > high)).alias("outside"),
            F.count(odd).alias("unknown"),
        )
        stacked = F.array(
            F.struct(*_issue("null_id_or_text", F.col("nulls"))),
            F.struct(*_issue("difficulty_out_of_band", F.col("outside"))),
            F.struct(*_issue("unknown_split", F.col("unknown"), F.col("odd"))),
        )
        found = counted.select(F.explode(stacked).alias("i")).groupBy("i.issue", "i.detail").agg(F.sum("i.n").alias("n"))
        repeated = df.groupBy("id").count().agg(F.sum(F.col("count") - 1).alias("n"))
        issues = (
            repeated.select(*_issue("duplicate_id", F.coalesce("n", F.lit(0))))
            .unionByName(found.select("issue", "n", "detail"))
            .where("n > 0")
        )
    if strict:
        found = issues.limit(20).collect()
        if found:
            told = "; ".join(f"{r.issue} n={r.n} {r.detail or ''}".strip() for r in found)
            raise ValueError("schema validation failed: " + told)
    return issues
