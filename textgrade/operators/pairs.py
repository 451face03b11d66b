"""Sums over pairs of rows without ever forming the pairs.

How many pairs agree in order is a count, for every row, of the rows below it in two directions: ``pair_sums`` of
``stretches`` does it for any weights of the earlier and the later row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textgrade.operators.ranks import SPACING
from textgrade.operators.stretches import STRETCH, pair_sums, written_cells


def concordant_pairs(ranked: DataFrame, group: list[str], pred: str, spacing: int | None = SPACING) -> DataFrame:
    """Pairs ordered the same way by both sides, per group, from ``joint_ranks`` cells."""
    spacing = min(spacing or STRETCH, STRETCH)
    found = pair_sums(ranked, group, "place_t", pred, ["cnt"], ["cnt"], spacing)
    return found.select(*group, F.col("total").cast("double").alias("concordant"))


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def pair_counts(
    ranked: DataFrame, group: list[str], pred: str, spacing: int | None = SPACING
) -> DataFrame:
    """Per group: all pairs, those tied on a side, and those ordered alike or apart by both.

    Takes ``joint_ranks`` cells; a group with a single row has zero pairs.
    """
    n = F.sum("cnt")

    def tied(own: str) -> Column:
        return F.sum(F.col("cnt") * (F.col(own).cast("double") - 1)) / 2

    ties = ranked.groupBy(*group).agg(
        n.alias("n"),
        tied("cnt").alias("tied_both"),
        tied("cnt_t").alias("tied_target"),
        tied("cnt_p").alias("tied_pred"),
    )
    agree = concordant_pairs(ranked, group, pred, spacing)
    concordant = F.coalesce(F.col("concordant"), F.lit(0.0))
    pairs = _pairs(F.col("n"))
    discordant = (
        pairs - F.col("tied_target") - F.col("tied_pred") + F.col("tied_both") - concordant
    )
    return ties.join(agree, group, "left").select(
        *group,
        "n",
        pairs.alias("pairs"),
        concordant.alias("concordant"),
        discordant.alias("discordant"),
        "tied_target",
        "tied_pred",
    )


def pairwise_hinge(
    df: DataFrame,
    batch: list[str],
    target: str,
    score: str,
    margin: float = 0.0,
    spacing: int = SPACING,
) -> DataFrame:
    """Mean margin ranking loss over the pairs of a batch whose targets differ.

    A pair (high, low) costs ``max(0, margin - (score_high - score_low))``. Each row enters the
    order twice: as a low row at ``score + margin`` and as a high row at its ``score``; a pair costs
    something exactly when the low entry lies above the high one. Batches without such a pair get 0.
    """
    clean = df.select(
        *batch, F.col(target).cast("double").alias("_t"), F.col(score).cast("double").alias("_s")
    ).where("_t is not null and _s is not null")
    cells = written_cells(clean, batch, ["_t", "_s"])
    # Sorting by falling position puts the costly low entries before the high ones.
    none = F.lit(0.0)
    low = F.struct(
        (none - (F.col("_s") + margin)).alias("at"), F.col("cnt").cast("double").alias("low"), none.alias("high")
    )
    high = F.struct((none - F.col("_s")).alias("at"), none.alias("low"), F.col("cnt").cast("double").alias("high"))
    numbers = cells.where(F.abs("_s") < F.lit(float("inf")))
    entries = numbers.select(*batch, "_t", F.explode(F.array(low, high)).alias("e")).select(*batch, "_t", "e.*")
    # A low entry below a high one costs the difference of their positions.
    weighed = entries.withColumns({"low_at": F.col("low") * -F.col("at"), "high_at": F.col("high") * F.col("at")})
    total = pair_sums(
        weighed, batch, "_t", "at", ["low_at", "low"], ["high", "high_at"], min(spacing, STRETCH)
    )
    # Scores that are no finite numbers leave no loss.
    odd = cells.groupBy(*batch).agg(F.sum(F.col("_s") * 0).alias("_odd"))
    for b in batch:
        odd = odd.where(F.col(b).isNotNull())
    total = odd.join(total, batch, "left").select(*batch, (F.coalesce("total", F.lit(0.0)) + F.col("_odd")).alias("cost"))
    tied = (
        cells.groupBy(*batch, "_t")
        .agg(F.sum("cnt").alias("_n"))
        .groupBy(*batch)
        .agg(F.sum("_n").alias("n"), F.sum(_pairs(F.col("_n"))).alias("tied"))
    )
    differing = _pairs(F.col("n")) - F.col("tied")
    return tied.join(total, batch, "left").select(
        *batch,
        differing.alias("pairs"),
        F.coalesce(F.try_divide(F.col("cost"), differing), F.lit(0.0)).alias("loss"),
    )
