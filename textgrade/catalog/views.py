"""The given tables seen as corpora, pools, gold labels and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textgrade.functions.draws import DRAW_RANGE, draw_number
from textgrade.operators.ranks import percentile_within_corpus
from textgrade.schema import coerce, with_defaults
from textgrade.sources.settled import settle, spread

POLARITY_BY_LANG = {"en": False, "de": True, "es": True, "fr": True}
VARIANT_WIDTHS = {"full": 4000.0, "no_pairwise": 8000.0, "no_pseudo": 16000.0}
SEEDS = (42, 43, 44)
SMALL = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts, which cost far more to process than to move."""
    return spread(table(spark, sf_dir, "documents"))


def canonical_docs(
    spark: SparkSession, sf_dir: str, corpus: str = "source", label: str = "n_chars"
) -> DataFrame:
    """Documents as corpus rows; ``label`` is their length or the (sparse) quality label."""
    docs = documents(spark, sf_dir)
    if label == "quality":
        docs = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return with_defaults(
        docs.select(
            F.concat(F.lit("docs:"), F.col("doc_id")).alias("id"),
            "text",
            F.col(corpus).alias("corpus"),
            F.col(label).cast("double").alias("native_label"),
            F.when(F.col("doc_id") % 7 != 0, F.lit(0.5)).alias("std_error"),
            F.when(F.col("doc_id") % 10 == 0, "poetry").otherwise("prose").alias("format_type"),
            F.col("lang").alias("language"),
        )
    )


def paragraph_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose line breaks become paragraph breaks."""
    return documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph documents as sources of free text, some of them empty."""
    docs = paragraph_docs(spark, sf_dir)
    empty = F.col("doc_id") % 13 == 0
    return docs.select(
        "source", "doc_id", F.lit("mixed").alias("domain"), F.when(empty, "").otherwise(F.col("text")).alias("text")
    )


def copied_docs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents with shouted, padded copies of some, and the reference texts they repeat."""
    docs = documents(spark, sf_dir)
    some = docs.where(F.col("doc_id") % 20 == 0)
    copies = some.select(
        F.concat(F.lit("copy:"), F.col("doc_id")).alias("id"),
        F.concat(F.lit("  "), F.translate("text", SMALL, SMALL.upper()), F.lit(" \n")).alias("text"),
    )
    own = docs.select(F.concat(F.lit("docs:"), F.col("doc_id")).alias("id"), "text")
    known = some.select("text").unionByName(table(spark, sf_dir, "benchmark").select("text"))
    return own.unionByName(copies), known


def metric_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers: balance as target, order total as prediction, market segment as slice."""
    money = F.col("o_totalprice").cast("decimal(18,2)")
    totals = (
        table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(money).cast("double").alias("p"))
    )
    return table(spark, sf_dir, "customer").join(
        totals, F.col("c_custkey") == F.col("o_custkey"), "left"
    ).select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_acctbal").alias("t"),
        "p",
        F.col("c_mktsegment").alias("slice"),
    )


def metric_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_quantity").alias("t"), F.col("l_extendedprice").alias("p"), F.col("l_returnflag").alias("slice")
    )


def wide_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a wide labelled corpus: a target, its error, formulas and solutions."""
    price, tax = F.col("l_extendedprice"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        price.alias("target"),
        tax.alias("se"),
        F.col("l_quantity").alias("formula_a"),
        F.col("l_discount").alias("formula_b"),
        (price + tax).alias("solution_a"),
        (price * (1 - F.col("l_discount"))).alias("solution_b"),
    )


def gold(spark: SparkSession, sf_dir: str, distinct_labels: bool = False) -> DataFrame:
    """Even vectors as labelled rows on the difficulty axis, stored as a gold table is."""
    label = F.col("label").cast("double")
    if distinct_labels:
        label = label + F.col("vec_id") / F.lit(1000.0)
    rows = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(
        F.concat(F.lit("gold:"), F.col("vec_id")).alias("id"),
        F.concat(F.lit("text "), F.col("vec_id")).alias("text"),
        F.lit("clear").alias("corpus"),
        label.alias("native_label"),
        F.when(F.col("vec_id") % 14 != 0, F.lit(2.0)).alias("std_error"),
        F.lit("train").alias("split"),
    )
    return settle(coerce(percentile_within_corpus(rows, polarity={"clear": False})))


def gold_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(
        F.concat(F.lit("gold:"), F.col("vec_id")).alias("id"), "embedding"
    )


def _pool_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd vectors, and copies of some gold vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    odd = vectors.where("vec_id % 2 = 1").withColumn("id", F.concat(F.lit("pool:"), F.col("vec_id")))
    copies = vectors.where("vec_id % 40 = 0").withColumn("id", F.concat(F.lit("copy:"), F.col("vec_id")))
    return odd.unionByName(copies)


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_defaults(
        _pool_ids(spark, sf_dir).select(
            "id",
            F.concat(F.lit("text "), F.col("vec_id")).alias("text"),
            F.lit("pool").alias("corpus"),
            F.lit("unlabeled").alias("split"),
        )
    )


def pool_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool_ids(spark, sf_dir).select("id", "embedding")


def teacher_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three teachers' predictions as a long table."""
    items = [
        F.struct(
            F.lit(k).alias("teacher"),
            (F.col("label") + F.col("vec_id") % (5 + k) - 2).cast("double").alias("pred"),
        )
        for k in range(3)
    ]
    return _pool_ids(spark, sf_dir).select("id", F.explode(F.array(*items)).alias("t")).select("id", "t.*")


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_small(spark, sf_dir).select(
        "id",
        F.col("t").alias("harmonized_difficulty"),
        F.when(F.col("id").cast("long") % 3 == 0, "train").otherwise("ood_corpus").alias("split"),
    )


def variant_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of three variants under three seeds: the target plus noise of known width."""
    runs = [
        F.struct(F.lit(v).alias("variant"), F.lit(s).alias("seed"), F.lit(w).alias("width"))
        for v, w in VARIANT_WIDTHS.items()
        for s in SEEDS
    ]
    rows = metric_small(spark, sf_dir).select("id", "t", F.explode(F.array(*runs)).alias("r"))
    rows = rows.select("id", "t", "r.*")
    noise = draw_number(7, "variant", "seed", "id") / F.lit(float(DRAW_RANGE)) - 0.5
    return rows.select("variant", "seed", "id", (F.col("t") + noise * F.col("width")).alias("pred"))


