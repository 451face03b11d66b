"""Rank-first scores of predictions, per slice, and the brackets they are read against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textgrade.functions.numbers import as_number, finite
from textgrade.operators.pairs import pair_counts
from textgrade.operators.ranks import SPACING, exact_quantiles, ranks_of_cells
from textgrade.operators.stretches import written_cells
from textgrade.sources.settled import settle

VALUE_METRICS = ("rmse", "mae", "mean_signed_error")
RANK_METRICS = ("spearman", "rank_rmse")
PAIR_METRICS = ("kendall", "pairwise_acc")
METRICS = ("spearman", "kendall", "pairwise_acc", "rank_rmse", "rmse", "mae", "mean_signed_error")

# Metrics for which a larger value is better.
HIGHER_IS_BETTER = ("spearman", "kendall", "pairwise_acc")


def clean_pairs(df: DataFrame, target: str, pred: str) -> DataFrame:
    """Target and prediction as doubles, null unless finite."""
    return df.withColumns({target: finite(F.col(target)), pred: finite(F.col(pred))})


def _value_columns(target: str, pred: str) -> dict[str, Column]:
    """Means over cells weighted by ``cnt``."""
    t, p, w = F.col(target), F.col(pred), F.col("cnt")

    def mean(value: Column) -> Column:
        return F.sum(w * value) / F.sum(w)

    return {
        "rmse": F.sqrt(mean((t - p) * (t - p))),
        "mae": mean(F.abs(t - p)),
        "mean_signed_error": mean(p - t),
    }


def _rank_columns() -> dict[str, Column]:
    w, n = F.col("cnt"), F.sum("cnt")
    t = F.col("rank_t") - (F.col("rows") + 1) / 2
    p = F.col("rank_p") - (F.col("rows") + 1) / 2
    spread = F.sqrt(F.sum(w * t * t)) * F.sqrt(F.sum(w * p * p))
    gap = F.sum(w * (t - p) * (t - p))
    return {
        "spearman": F.when(n >= 3, F.try_divide(F.sum(w * t * p), spread)),
        "rank_rmse": F.when(n >= 2, F.sqrt(gap / n) / n),
    }


def score_cells(
    cells: DataFrame,
    group: list[str],
    target: str,
    pred: str,
    metrics: tuple[str, ...] = METRICS,
    spacing: int = SPACING,
    written: bool = False,
) -> DataFrame:
    """Metrics per group of clean cells ``(group, target, pred, cnt)``.

    Ranks and pair counts are computed only where a metric asks for them. Groups without a clean
    row are absent. Several rows may be one cell; ``written`` says that they come from ``written_cells``.
    """
    values = {k: v for k, v in _value_columns(target, pred).items() if k in metrics}
    if not set(metrics) & {*RANK_METRICS, *PAIR_METRICS}:
        both = cells.where(F.col(target).isNotNull() & F.col(pred).isNotNull())
        return both.groupBy(*group).agg(*[v.alias(k) for k, v in values.items()])
    if not written:
        both = cells.where(F.col(target).isNotNull() & F.col(pred).isNotNull())
        cells = written_cells(both, group, [target, pred])
    ranked = ranks_of_cells(cells, group, target, pred, spacing)
    if set(metrics) & set(PAIR_METRICS):
        ranked = settle(ranked)
    values.update({k: v for k, v in _rank_columns().items() if k in metrics})
    columns = [v.alias(k) for k, v in values.items()] or [F.sum("cnt").alias("_n")]
    scores = ranked.groupBy(*group).agg(*columns)
    if set(metrics) & set(PAIR_METRICS):
        c = pair_counts(ranked, group, pred, spacing)
        order = F.col("pairs") - F.col("tied_target")
        spread = F.sqrt(order) * F.sqrt(F.col("pairs") - F.col("tied_pred"))
        tau = F.try_divide(F.col("concordant") - F.col("discordant"), spread)
        agree = F.try_divide(F.col("concordant"), order)
        pair_scores = c.select(
            *group, F.when(F.col("n") >= 3, tau).alias("kendall"), agree.alias("pairwise_acc")
        )
        scores = scores.join(pair_scores, group)
    return scores.select(*group, *[m for m in METRICS if m in metrics])


def score_groups(
    df: DataFrame,
    group: list[str],
    target: str,
    pred: str,
    metrics: tuple[str, ...] = METRICS,
    spacing: int = SPACING,
) -> DataFrame:
    """Metrics and ``n`` (finite targets, with or without prediction) for every group of rows."""
    clean = clean_pairs(df, target, pred).select(*group, target, pred)
    written = not set(metrics) <= set(VALUE_METRICS)
    if written:
        cells = written_cells(clean, group, [target, pred])
    else:
        cells = clean.groupBy(*group, target, pred).agg(F.count(F.lit(1)).alias("cnt"))
    sizes = cells.groupBy(*group).agg(
        F.coalesce(F.sum(F.when(F.col(target).isNotNull(), F.col("cnt"))), F.lit(0)).alias("n")
    )
    scores = score_cells(cells, group, target, pred, metrics, spacing, written)
    return sizes.join(scores, group, "left").select(
        *group, *[m for m in METRICS if m in metrics], "n"
    )


def score_predictions(
    df: DataFrame, target: str, pred: str, metrics: tuple[str, ...] = METRICS
) -> DataFrame:
    """All metrics of a whole table, as one row."""
    return score_groups(df.withColumn("_all", F.lit(0)), ["_all"], target, pred, metrics).drop("_all")


def score_against_bracket(
    df: DataFrame,
    pred_col: str,
    target_col: str,
    group_col: str | None = None,
    metrics: tuple[str, ...] = METRICS,
    spacing: int = SPACING,
) -> DataFrame:
    """One row ``ALL`` and one per non-null group; ranks are taken anew inside each slice."""
    own = F.struct(F.lit(True).alias("is_all"), F.lit("ALL").alias("group"))
    slices = [own]
    if group_col and group_col in df.columns:
        name = F.col(group_col).cast("string").alias("group")
        slices.append(F.struct(F.lit(False).alias("is_all"), name))
    own_group = [group_col] if len(slices) > 1 else []
    rows = (
        written_cells(clean_pairs(df, target_col, pred_col), own_group, [target_col, pred_col])
        .select(target_col, pred_col, "cnt", F.explode(F.array(*slices)).alias("s"))
        .select("s.*", target_col, pred_col, "cnt")
        .where("group is not null")
    )
    keys = ["is_all", "group"]
    counted = F.sum(F.when(F.col(target_col).isNotNull(), F.col("cnt")))
    sizes = rows.groupBy(*keys).agg(F.coalesce(counted, F.lit(0)).alias("n"))
    scores = score_cells(rows, keys, target_col, pred_col, metrics, spacing, written=True)
    return sizes.join(scores, keys, "left").select(
        *keys, *[m for m in METRICS if m in metrics], "n"
    )


def attach_predictions(table: DataFrame, preds: DataFrame) -> DataFrame:
    """Rows that have a prediction, joined by id as text."""
    right = preds.select(F.col("id").cast("string").alias("_id"), F.col("pred"))
    return table.join(right, F.col("id").cast("string") == F.col("_id")).drop("_id")


def mean_predictor_rmse(df: DataFrame, target: str) -> DataFrame:
    """Error of always predicting the mean: the trivial floor."""
    return df.select(as_number(F.col(target)).alias("y")).agg(F.stddev_pop("y").alias("rmse"))


def label_noise_floor(df: DataFrame, se_col: str, spacing: int = SPACING) -> DataFrame:
    """Mean and exact median of the label standard errors, one row."""
    se = df.select(F.lit(0).alias("g"), as_number(F.col(se_col)).alias("se"))
    mean = se.groupBy("g").agg(F.avg("se").alias("mean_se"))
    median = exact_quantiles(se, ["g"], "se", {"median_se": 0.5}, spacing)
    return mean.join(median, "g", "left").select("mean_se", "median_se")


def _unpivot(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    entries = [F.struct(F.lit(c).alias("reference"), as_number(F.col(c)).alias("x")) for c in columns]
    return (
        df.select(as_number(F.col(target)).alias("y"), F.explode(F.array(*entries)).alias("e"))
        .select("y", "e.*")
        .where("y is not null and x is not null")
    )


def _per_reference(
    df: DataFrame, target: str, columns: list[str], extra: dict[str, Callable[[Column, Column], Column]], metrics, spacing
) -> DataFrame:
    """Scores of several columns against one target: all columns in one pass, absent ones null.

    Row counts and ``extra`` are summed over the wide rows, where they lie; only ranks need a row a column.
    """
    spark = df.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "at int, reference string")
    here = [c for c in columns if c in df.columns]
    wanted = [*metrics, *extra]
    if not here:
        empty = [F.lit(None).cast("double").alias(c) for c in wanted]
        return names.select("reference", *empty, F.lit(0).cast("long").alias("n"))
    scores = score_groups(_unpivot(df, target, here), ["reference"], "y", "x", metrics, spacing).drop("n")
    y, counted = as_number(F.col(target)), []
    for name in here:
        x = as_number(F.col(name))
        pair = F.when(x.isNotNull(), y), F.when(y.isNotNull(), x)
        facts = {"n": F.count(pair[0]), **{k: v(*pair) for k, v in extra.items()}}
        counted.append(F.struct(F.lit(name).alias("reference"), *[v.alias(k) for k, v in facts.items()]))
    sizes = df.agg(F.array(*counted).alias("all")).select(F.explode("all").alias("e")).select("e.*")
    return (
        names.join(sizes, "reference", "left")
        .join(scores, "reference", "left")
        .select("reference", *wanted, F.coalesce("n", F.lit(0)).alias("n"))
    )


def _r2(y: Column, x: Column) -> Column:
    """Squared correlation of ``y`` and ``x``, null where either is."""
    spread = F.stddev_pop(y) * F.stddev_pop(x)
    r = F.try_divide(F.covar_pop(y, x), spread)
    return F.when(F.count(y) >= 3, r * r)


def formula_baselines(
    df: DataFrame, target_col: str, formula_cols: list[str], spacing: int = SPACING
) -> DataFrame:
    """Spearman and linear R^2 of each formula column; fewer than three pairs give nulls."""
    return _per_reference(df, target_col, formula_cols, {"r2": _r2}, ("spearman",), spacing)


def solution_ceilings(
    df: DataFrame, target_col: str, solution_cols: list[str], spacing: int = SPACING
) -> DataFrame:
    """RMSE and Spearman of each column of known good predictions."""
    return _per_reference(df, target_col, solution_cols, {}, ("rmse", "spearman"), spacing)


def reference_bracket(
    df: DataFrame,
    target_col: str,
    se_col: str,
    formula_cols: list[str],
    solution_cols: list[str],
    spacing: int = SPACING,
) -> DataFrame:
    """Floor, noise, baselines and ceilings as one long table ``(section, reference, metric, value, n)``."""
    target = as_number(F.col(target_col))
    se = as_number(F.col(se_col)) if se_col in df.columns else F.lit(None).cast("double")
    whole = df.agg(
        F.count(target).alias("n"), F.stddev_pop(target).alias("sd"), F.count(se).alias("n_se"), F.avg(se).alias("mean_se")
    )
    if se_col in df.columns:
        errors = df.select(F.lit(0).alias("g"), se.alias("se"))
        median = exact_quantiles(errors, ["g"], "se", {"median_se": 0.5}, spacing).select("median_se")
        whole = whole.withColumn("median_se", median.scalar())
    else:
        whole = whole.withColumn("median_se", F.lit(None).cast("double"))

    def entry(section: str, reference, metric: str, value: str, n: str) -> Column:
        values = {"section": F.lit(section), "reference": reference, "metric": F.lit(metric), "value": F.col(value), "n": F.col(n)}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    def listed(names: list[str], section: str, metrics: tuple[str, ...]) -> Column:
        entries = F.array(*[entry(section, F.col("reference"), m, m, "n") for m in metrics])
        return F.when(F.col("reference").isin(*names), entries).otherwise(F.slice(entries, 1, 0))

    head = F.array(
        entry("trivial_floor", F.lit(target_col), "rmse", "sd", "n"),
        entry("noise_floor", F.lit(se_col), "mean_se", "mean_se", "n_se"),
        entry("noise_floor", F.lit(se_col), "median_se", "median_se", "n_se"),
    )
    columns = list(dict.fromkeys([*formula_cols, *solution_cols]))
    rest = _per_reference(df, target_col, columns, {"r2": _r2}, ("rmse", "spearman"), spacing)
    both = F.concat(listed(formula_cols, "formula", ("spearman", "r2")), listed(solution_cols, "ceiling", ("rmse", "spearman")))
    return (
        whole.select(F.explode(head).alias("e"))
        .unionByName(rest.select(F.explode(both).alias("e")))
        .select("e.*")
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
