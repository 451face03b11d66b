"""Compare experiment variants from their prediction tables ``(variant, seed, id, pred)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textgrade.functions.numbers import as_number, fold_sum, values_by_name
from textgrade.operators.bootstrap import paired_bootstrap_diff
from textgrade.operators.metrics import score_groups
from textgrade.operators.ranks import SPACING
from textgrade.sources.settled import settle

HOLDOUT = "ood_corpus"
TARGET = "harmonized_difficulty"
SIGNIFICANT = 0.05


def _holdout(table: DataFrame, split: str, target: str) -> DataFrame:
    held = table.where(F.col("split") == split)
    return held.select(F.col("id").cast("string").alias("id"), as_number(F.col(target)).alias("target"))


def score_variants(
    table: DataFrame,
    preds: DataFrame,
    holdout_split: str = HOLDOUT,
    target_col: str = TARGET,
    spacing: int = SPACING,
) -> DataFrame:
    """Spearman and RMSE on the holdout for every ``(variant, seed)``, all in one plan.

    ``n`` is the number of holdout rows with a target, predicted or not. Repeated prediction ids are an error.
    """
    held = _holdout(table, holdout_split, target_col)
    keyed = preds.select("variant", "seed", F.col("id").cast("string").alias("id"), as_number(F.col("pred")).alias("pred"))
    several = F.raise_error(F.lit("several predictions for one id of the same variant and seed")).cast("double")
    once = keyed.groupBy("variant", "seed", "id").agg(F.count(F.lit(1)).alias("times"), F.max("pred").alias("pred"))
    once = once.select("variant", "seed", "id", F.when(F.col("times") > 1, several).otherwise(F.col("pred")).alias("pred"))
    joined = once.join(held, "id")
    scores = score_groups(joined, ["variant", "seed"], "target", "pred", ("spearman", "rmse"), spacing)
    n = held.agg(F.count("target").alias("n"))
    runs = preds.select("variant", "seed").distinct()
    return runs.join(scores.drop("n"), ["variant", "seed"], "left").withColumn("n", n.scalar())


def aggregate_seeds(scores: DataFrame) -> DataFrame:
    """Mean and sample deviation over seeds per variant, best Spearman first."""
    return (
        scores.groupBy("variant")
        .agg(
            F.avg("spearman").alias("spearman_mean"),
            F.stddev_samp("spearman").alias("spearman_std"),
            F.avg("rmse").alias("rmse_mean"),
            F.stddev_samp("rmse").alias("rmse_std"),
            F.countDistinct("seed").alias("seeds"),
        )
        .orderBy(F.col("spearman_mean").desc_nulls_last(), "variant")
    )


def mean_prediction(preds: DataFrame) -> DataFrame:
    """``(variant, id, pred)``: mean over seeds, missing values left out, same bits every time.

    Two predictions for one variant, seed and id are an error.
    """
    keyed = preds.withColumn("id", F.col("id").cast("string"))
    slots = values_by_name(keyed, ["variant", "id"], "seed", "pred")
    values = F.array_compact(F.transform("values", lambda v: v["value"]))
    present = slots.select("variant", "id", values.alias("values"))
    mean = F.try_divide(fold_sum(F.col("values")), F.size("values"))
    return present.select("variant", "id", mean.alias("pred"))


def compare_to_full(
    table: DataFrame,
    preds: DataFrame,
    holdout_split: str = HOLDOUT,
    target_col: str = TARGET,
    full: str = "full",
    n_boot: int = 2000,
    seed: int = 42,
    mode: str = "exact",
    spacing: int = SPACING,
) -> DataFrame:
    """Paired bootstrap of the full variant against each other one, all variants in one plan."""
    means = mean_prediction(preds)
    held = _holdout(table, holdout_split, target_col)
    mine = means.where(F.col("variant") == full).select("id", F.col("pred").alias("pred_full"))
    others = means.where(F.col("variant") != full).withColumnRenamed("pred", "pred_variant")
    joined = settle(others.join(mine, "id").join(held, "id"))
    out = paired_bootstrap_diff(
        joined, "id", "target", "pred_full", "pred_variant",
        group=["variant"], n_boot=n_boot, seed=seed, mode=mode, spacing=spacing,
    )
    return out.withColumn("significant", F.col("p_full_not_better") < SIGNIFICANT)
