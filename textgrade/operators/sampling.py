"""Stratified sampling for diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from textgrade.functions.draws import draw_key
from textgrade.functions.text import difficulty_proxy
from textgrade.operators.ranks import SPACING, quantile_bin, unique_rank
from textgrade.sources.settled import settle

POOL_ROWS = 200_000
BINS = 10

# A table of this many ids is about 50 MB and may be broadcast.
BROADCAST_IDS = 1_000_000


def difficulty_bins(
    df: DataFrame, n_bins: int = BINS, seed: int = 42, spacing: int = SPACING
) -> DataFrame:
    """``(id, corpus, proxy, draw, rank, bin)``: each text's difficulty rank in the whole pool.

    Narrow and settled: ranking writes the short columns first, so the texts are read once. Ties
    of the proxy are ordered by id.
    """
    narrow = df.select(
        "id",
        "corpus",
        difficulty_proxy("text").alias("proxy"),
        draw_key(seed, "id").alias("draw"),
    )
    ranked = unique_rank(narrow, ["proxy", "id"], spacing=spacing)
    return settle(ranked.withColumn("bin", quantile_bin("rank", "rows", n_bins)))


def smallest_draws(keyed: DataFrame, group: list[str], take: int, groups: int) -> DataFrame:
    """The ``take`` rows of each group with the smallest ``(draw, id)``, or all of a small group.

    Counts per group and 4-digit head of the draw show where the cut lies, so only the rows that
    share the head of the cut are sorted. ``groups`` is the counted number of groups: the table of
    cuts has at most one row for each and is broadcast while that is few, so that rows of a large
    group stay where they are.
    """
    headed = keyed.withColumn("head", F.substring("draw", 1, 4))
    heads = headed.groupBy(*group, "head").count()
    running = F.sum("count").over(Window.partitionBy(*group).orderBy("head"))
    cut = (
        heads.withColumn("before", running - F.col("count"))
        .where((F.col("before") < take) & (F.col("before") + F.col("count") >= take))
        .select(*group, F.col("head").alias("cut_head"), (take - F.col("before")).alias("left"))
    )
    joined = headed.join(F.broadcast(cut) if groups <= BROADCAST_IDS else cut, group, "left")
    whole = joined.where(F.col("cut_head").isNull() | (F.col("head") < F.col("cut_head")))
    inside = Window.partitionBy(*group, "head").orderBy("draw", "id")
    part = (
        joined.where(F.col("head") == F.col("cut_head"))
        .withColumn("place", F.row_number().over(inside))
        .where(F.col("place") <= F.col("left"))
    )
    return whole.select(*keyed.columns).unionByName(part.select(*keyed.columns))


def select_diverse(
    df: DataFrame,
    n_total: int = POOL_ROWS,
    n_bins: int = BINS,
    seed: int = 42,
    spacing: int = SPACING,
) -> DataFrame:
    """About ``n_total`` rows drawn evenly over corpus x difficulty bin, never more.

    A small bucket gives all it has; what it lacks is not taken elsewhere. A pool that is small
    enough comes back whole.
    """
    binned = difficulty_bins(df, n_bins, seed, spacing)
    sizes = binned.groupBy("corpus", "bin").count()
    known = F.col("corpus").isNotNull()
    counted = sizes.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.count_if(known).alias("buckets")).first()
    if counted.rows <= n_total:
        return df
    bucketed = binned.where(known)
    buckets = counted.buckets
    per = max(n_total // max(buckets, 1), 1)
    keyed = bucketed.select("id", "corpus", "bin", "draw")
    picked = smallest_draws(keyed, ["corpus", "bin"], per, buckets)
    if buckets > n_total:
        picked = picked.orderBy("draw", "id").limit(n_total)
    ids = picked.select("id")
    return df.join(F.broadcast(ids) if n_total <= BROADCAST_IDS else ids, "id", "left_semi")
