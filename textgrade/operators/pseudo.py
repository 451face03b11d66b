"""Accept or reject model-made labels, and place the accepted ones on the difficulty axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textgrade.functions.numbers import as_number, fold_sum, values_by_name
from textgrade.operators.neighbors import map_to_axis, nearest_gold
from textgrade.operators.ranks import SPACING, exact_quantiles
from textgrade.schema import coerce
from textgrade.sources.settled import settle

K_SE = 1.0
DEDUP_COSINE = 0.05
NARROWEST_RANGE = 1e-9


def teacher_names(preds: DataFrame) -> list:
    """The teachers of a prediction table, in order."""
    return sorted(r.teacher for r in preds.select("teacher").distinct().collect())


def ensemble_stats(preds: DataFrame, teachers: list) -> DataFrame:
    """``(id, mean, std)`` over the named teachers of a long table ``(id, teacher, pred)``.

    ``std`` is the population deviation. An id without all teachers' predictions has nulls; one
    with two predictions of a teacher is an error. Values are added in the teachers' order, so
    results repeat to the bit.
    """
    k = len(teachers)
    named = F.filter("values", lambda v: v["name"].isin(teachers)) if teachers else F.col("values")
    slots = values_by_name(preds, ["id"], "teacher", "pred")
    slots = slots.select("id", F.transform(named, lambda v: v["value"]).alias("values"))
    whole = (F.size("values") == k) & ~F.exists("values", lambda x: x.isNull())
    rows = slots.select("id", F.when(whole, F.col("values")).alias("values"))
    rows = rows.select("id", "values", (fold_sum(F.col("values")) / k).alias("mean"))
    spread = fold_sum(F.transform("values", lambda x: (x - F.col("mean")) * (x - F.col("mean"))))
    return rows.select("id", "mean", F.sqrt(spread / k).alias("std"))


def missing_inputs(pool: DataFrame, preds: DataFrame, vectors: DataFrame) -> DataFrame:
    """Pool ids without predictions or without an embedding (none, or a null one), as one row of counts."""
    ids = pool.select("id")
    no_pred = ids.join(preds.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("no_pred"))
    no_vector = ids.join(vectors.where("embedding is not null").select("id"), "id", "left_anti").agg(
        F.count(F.lit(1)).alias("no_embedding")
    )
    return no_pred.withColumn("no_embedding", no_vector.scalar())


def judge_pool(
    pool: DataFrame,
    gold: DataFrame,
    preds: DataFrame,
    pool_vectors: DataFrame,
    gold_vectors: DataFrame,
    k_se: float = K_SE,
    max_std: float | None = None,
    dedup_cosine: float = DEDUP_COSINE,
    teachers: list | None = None,
    spacing: int = SPACING,
) -> DataFrame:
    """The gates for every pool id: a narrow settled table with one flag per gate and ``keep``.

    ``near_se`` asks that the mean prediction lies within ``k_se`` standard errors of the nearest
    gold label, ``agreed`` that the teachers differ by at most ``max_std`` (by default the median
    over the whole pool), ``near_dup`` marks near copies of gold.
    """
    ids = pool.select("id")
    stats = ensemble_stats(preds, teacher_names(preds) if teachers is None else teachers)
    near = nearest_gold(pool_vectors.join(ids, "id", "left_semi"), gold_vectors)
    mean_se = F.avg(as_number(F.col("std_error")))
    fallback = gold.agg(mean_se).first()[0]
    labels = gold.select(
        F.col("id").alias("neighbour"),
        as_number(F.col("native_label")).alias("neighbour_label"),
        F.coalesce(as_number(F.col("std_error")), F.lit(fallback).cast("double")).alias("neighbour_se"),
    )
    judged = settle(ids.join(stats, "id", "left").join(near.join(labels, "neighbour"), "id", "left"))
    if max_std is None:
        flat = judged.select(F.lit(0).alias("g"), "std")
        found = exact_quantiles(flat, ["g"], "std", {"median": 0.5}, spacing).first()
        max_std = found["median"] if found else None
    limit = F.lit(max_std).cast("double")

    def sure(condition):
        return F.coalesce(condition, F.lit(False))

    near_se = sure(
        F.abs(F.col("mean") - F.col("neighbour_label")) <= F.lit(k_se) * F.col("neighbour_se")
    )
    flagged = judged.select(
        "*",
        near_se.alias("near_se"),
        sure(F.col("std") <= limit).alias("agreed"),
        sure(F.col("distance") < F.lit(dedup_cosine)).alias("near_dup"),
    )
    return flagged.withColumn("keep", F.expr("near_se and agreed and not near_dup"))


def gate_report(judged: DataFrame) -> DataFrame:
    """How many rows each gate let through, as one row."""
    return judged.agg(
        F.count(F.lit(1)).alias("pool"),
        F.count_if("near_se").alias("near_se"),
        F.count_if("agreed").alias("agreed"),
        F.count_if("near_dup").alias("near_dup"),
        F.count_if("keep").alias("kept"),
    )


def label_kept(
    pool: DataFrame,
    gold: DataFrame,
    judged: DataFrame,
    extrapolate: bool = True,
    spacing: int = SPACING,
) -> DataFrame:
    """Pseudo-labelled rows for the ids that passed.

    Confidence falls with teacher disagreement, and again with the distance of the prediction from
    the range of gold labels.
    """
    native = as_number(F.col("native_label"))
    edge = gold.agg(F.min(native).alias("lo"), F.max(native).alias("hi")).first()
    kept = judged.where("keep").select("id", "mean", "std")
    placed = map_to_axis(kept, gold, "mean", "axis", extrapolate, spacing=spacing)
    if edge.lo is None:
        over = F.lit(0.0)
        width = 1.0
    else:
        width = max(edge.hi - edge.lo, NARROWEST_RANGE)
        over = F.greatest(
            F.lit(0.0), F.lit(edge.lo) - F.col("mean"), F.col("mean") - F.lit(edge.hi)
        )
    confidence = (1 / (1 + F.col("std"))) * (1 / (1 + over / F.lit(width)))
    labelled = pool.join(placed, "id").withColumns(
        {
            "native_label": F.col("mean"),
            "native_scale": F.lit("clear_bt_pseudo"),
            "harmonized_difficulty": F.col("axis"),
            "mapping_method": F.lit("pseudo_teacher"),
            "mapping_confidence": confidence,
            "std_error": F.col("std"),
            "is_pseudo": F.lit(True),
            "split": F.lit("train"),
        }
    )
    return coerce(labelled)


def generate_pseudo_labels(
    pool: DataFrame,
    gold: DataFrame,
    preds: DataFrame,
    pool_vectors: DataFrame,
    gold_vectors: DataFrame,
    k_se: float = K_SE,
    max_std: float | None = None,
    dedup_cosine: float = DEDUP_COSINE,
    extrapolate: bool = True,
    check: bool = True,
    spacing: int = SPACING,
) -> DataFrame:
    """All gates, then the labels. ``check`` fails early where a pool row lacks an input."""
    if check:
        lacking = missing_inputs(pool, preds, pool_vectors).first()
        if lacking.no_pred or lacking.no_embedding:
            raise ValueError(
                f"{lacking.no_pred} pool rows without predictions, "
                f"{lacking.no_embedding} without an embedding"
            )
    judged = judge_pool(
        pool, gold, preds, pool_vectors, gold_vectors, k_se, max_std, dedup_cosine, spacing=spacing
    )
    return label_kept(pool, gold, judged, extrapolate, spacing)
