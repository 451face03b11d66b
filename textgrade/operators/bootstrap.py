"""Bootstrap intervals for any metric, on resamples that are a function of a seed.

Two ways to resample. ``exact`` draws n row positions for each replicate, as textbooks do.
``poisson`` gives each row an independent Poisson(1) count per replicate, so nothing is shuffled by
row and value metrics reduce to one partial sum per replicate and partition; for large n both have
the same distribution. The caller names the way; the size of the data never changes it.

Replicates are independent, so they are what is dealt out: each task has its share of them and the
narrow rows of one group, whose draws, counts and ranks are then arrays of that task. That is for
groups measured to have at most ``STRETCHES`` stretches of rows, which bounds a task's memory.

Beyond that replicates come in blocks of ``WIDTH``: a row carries its counts in all replicates of a
block side by side, and ranks are running totals of that many counters at once. What is shuffled and
sorted is a row per block, never one per replicate. Draws of ``exact`` travel as lists, one for each
stretch of ``PLACES`` positions. Value metrics under Poisson counts are partial sums of whatever rows
a task has, at any size. Pair metrics alone still take a row per replicate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from textgrade.functions.draws import DRAW_RANGE, DrawBlocks, draw_number
from textgrade.functions.numbers import finite
from textgrade.operators.metrics import HIGHER_IS_BETTER, PAIR_METRICS, VALUE_METRICS, score_cells
from textgrade.operators.ranks import SPACING, running_totals, unique_rank
from textgrade.sources.settled import settle

# Replicates in a block, and positions whose draws of a block make one list.
WIDTH = 16
PLACES = 2**14
COUNTS = [f"_w{k}" for k in range(WIDTH)]
# Stretches of rows, about 80 bytes each, that a task holds to score whole replicates. Partial sums that it holds.
STRETCHES = 8
PARTIAL_SUMS = 2**20

# Cumulative Poisson(1) probabilities for counts 0, 1, 2, ..., as far as 32-bit draws can tell apart.
POISSON_STEPS = (
    0.36787944117144233,
    0.7357588823428847,
    0.9196986029286058,
    0.9810118431238462,
    0.9963401531726563,
    0.9994058151824183,
    0.999916758850712,
    0.9999897508033253,
    0.9999988747974020,
    0.9999998885745217,
    0.9999999899522336,
    0.9999999991683893,
    0.9999999999364022,
)


def poisson_count(u: Column) -> Column:
    """Poisson(1) count for a uniform draw in [0, 1), the likeliest counts first."""
    count = F.when(u < POISSON_STEPS[0], 0)
    for k, step in enumerate(POISSON_STEPS[1:], 1):
        count = count.when(u < step, k)
    return count.otherwise(len(POISSON_STEPS))


def _positions(df: DataFrame, group: list[str], row_id: str, values: list[str], spacing: int):
    """Rows finite in all values, numbered from 0 by id inside each group."""
    clean = df.select(*group, F.col(row_id).alias("row_id"), *[finite(F.col(v)).alias(v) for v in values])
    for name in [*group, *values]:
        clean = clean.where(F.col(name).isNotNull())
    ranked = unique_rank(clean, ["row_id"], group, spacing)
    return settle(ranked.withColumn("position", F.col("rank") - 1).drop("rank"), spread_by="row_id")


def resample(
    rows: DataFrame, group: list[str], values: list[str], n_boot: int, seed: int, mode: str
) -> DataFrame:
    """Replicates as weighted rows ``(group, rep, values, cnt)``."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep")
    if mode == "poisson":
        drawn = rows.select(*group, *values, "row_id", reps)
        drawn = drawn.withColumn("_u", draw_number(seed, "rep", "row_id") / F.lit(DRAW_RANGE))
        drawn = drawn.withColumn("cnt", poisson_count(F.col("_u")))
        return drawn.where("cnt > 0").select(*group, "rep", *values, F.col("cnt").cast("long"))
    draws = rows.select(*group, "position", "rows", reps).select(
        *group,
        "rep",
        F.pmod(draw_number(seed, "rep", "position"), F.col("rows")).alias("position"),
    )
    counts = draws.groupBy(*group, "rep", "position").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.join(rows.select(*group, "position", *values), [*group, "position"]).select(
        *group, "rep", *values, "cnt"
    )


def resample_blocks(
    rows: DataFrame, group: list[str], values: list[str], n_boot: int, seed: int, mode: str
) -> DataFrame:
    """Replicates side by side: rows ``(group, block, values, _w0, _w1, ...)``.

    ``_w<k>`` is the row's count in replicate ``block * WIDTH + k``. The last block may hold replicates beyond
    ``n_boot``, which are empty in ``exact`` mode and for the caller to leave out in both.
    """
    if mode == "poisson":
        blocks = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // WIDTH))).alias("block")
        first = F.col("block") * WIDTH
        draws = F.transform(
            F.sequence(first, first + WIDTH - 1), lambda rep: draw_number(seed, rep, "row_id") / F.lit(DRAW_RANGE)
        )
        drawn = rows.select(*group, *values, "row_id", blocks)
        drawn = drawn.select(*group, "block", *values, F.transform(draws, poisson_count).alias("counts"))
        return drawn.select(
            *group, "block", *values, *[F.get("counts", F.lit(k)).cast("long").alias(c) for k, c in enumerate(COUNTS)]
        )
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("rep")
    draws = rows.select(*group, "position", "rows", reps).select(
        *group, "rep", F.pmod(draw_number(seed, "rep", "position"), F.col("rows")).alias("position")
    )
    code = (F.col("position") * WIDTH + F.col("rep") % WIDTH).alias("code")
    placed = draws.select(
        *group, F.expr(f"rep div {WIDTH}").alias("block"), F.expr(f"position div {PLACES}").alias("part"), code
    )
    lists = placed.groupBy(*group, "block", "part").agg(F.collect_list("code").alias("codes"))
    codes = lists.select(*group, "block", "part", F.explode("codes").alias("code"))
    # grouped by what the lists lie by already: nothing moves
    codes = codes.withColumn("position", F.expr(f"code div {WIDTH}"))
    counts = codes.groupBy(*group, "block", "part", "position").agg(
        *[F.count(F.when(F.col("code") % WIDTH == k, 1)).alias(c) for k, c in enumerate(COUNTS)]
    )
    return counts.join(rows.select(*group, "position", *values), [*group, "position"]).select(
        *group, "block", *values, *COUNTS
    )


def _middle_ranks(cells: DataFrame, by: list[str], value: str, mark: str, spacing: int, small: bool) -> DataFrame:
    """Add ``<mark><k>``: the average rank of ``value`` in each replicate, less the middle rank of that replicate."""
    if small:
        whole = Window.partitionBy(*by)
        order = whole.orderBy(value)
        upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        same = order.rangeBetween(Window.currentRow, Window.currentRow)
        return cells.select(
            "*",
            *[
                (F.sum(c).over(upto) - F.sum(c).over(same) / 2 - F.sum(c).over(whole) / 2).alias(f"{mark}{k}")
                for k, c in enumerate(COUNTS)
            ],
        )
    own = cells.groupBy(*by, value).agg(*[F.sum(c).alias(c) for c in COUNTS])
    totals = running_totals(own, by, [value], COUNTS, spacing)
    ranks = [
        (F.col(f"before_{c}") + F.col(c) / 2 - F.col(f"all_{c}") / 2).alias(f"{mark}{k}") for k, c in enumerate(COUNTS)
    ]
    return cells.join(totals.select(*by, value, *ranks), [*by, value])


def score_blocks(
    drawn: DataFrame, group: list[str], target: str, preds: list[str], metric: str, n_boot: int, spacing: int = SPACING
) -> DataFrame:
    """``(group, rep, scores)`` from rows of ``resample_blocks``: an array with the metric of each prediction.

    Takes value and rank metrics. A replicate in which a metric is undefined has a null there.
    """
    by = [*group, "block"]
    cells = drawn.groupBy(*by, target, *preds).agg(*[F.sum(c).alias(c) for c in COUNTS])
    if metric not in VALUE_METRICS:
        cells = settle(cells)
        spacing = max(spacing // WIDTH, 1)
        largest = cells.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        for at, value in enumerate([target, *preds]):
            cells = _middle_ranks(cells, by, value, f"_r{at}_", spacing, largest <= spacing)

    def score(k: int, at: int) -> Column:
        w = F.col(COUNTS[k])
        n = F.sum(w)
        if metric in VALUE_METRICS:
            gap = F.col(preds[at - 1]) - F.col(target)
            if metric == "rmse":
                return F.sqrt(F.try_divide(F.sum(w * gap * gap), n))
            return F.try_divide(F.sum(w * (F.abs(gap) if metric == "mae" else gap)), n)
        t, p = F.col(f"_r0_{k}"), F.col(f"_r{at}_{k}")
        if metric == "rank_rmse":
            return F.when(n >= 2, F.sqrt(F.sum(w * (t - p) * (t - p)) / n) / n)
        spread = F.sqrt(F.sum(w * t * t)) * F.sqrt(F.sum(w * p * p))
        return F.when(n >= 3, F.try_divide(F.sum(w * t * p), spread))

    of_rep = [F.array(*[score(k, at) for at in range(1, len(preds) + 1)]) for k in range(WIDTH)]
    scores = cells.groupBy(*by).agg(F.array(*of_rep).alias("_scores"))
    rep = (F.col("block") * WIDTH + F.col("_k")).cast("int").alias("rep")
    return (
        scores.select(*group, "block", F.posexplode("_scores").alias("_k", "scores"))
        .select(*group, rep, "scores")
        .where(F.col("rep") < n_boot)
    )


def _poisson_counts(draws: np.ndarray) -> np.ndarray:
    return np.searchsorted(POISSON_STEPS, draws / DRAW_RANGE, side="right")


def _value_parts(target: np.ndarray, preds: list[np.ndarray], metric: str) -> list[np.ndarray]:
    """What a value metric adds up over rows, for each prediction."""
    gaps = [p - target for p in preds]
    return [g * g if metric == "rmse" else np.abs(g) if metric == "mae" else g for g in gaps]


def _rank_score(metric: str, counts: np.ndarray, t: np.ndarray, p: np.ndarray) -> float | None:
    """A rank metric of one replicate from the rows' counts and ranks less the middle rank."""
    n = counts.sum()
    if metric == "rank_rmse":
        return float(np.sqrt(counts @ (t - p) ** 2 / n) / n) if n >= 2 else None
    weighted = counts * t
    spread = float(np.sqrt(weighted @ t) * np.sqrt((counts * p) @ p))
    return float(weighted @ p) / spread if n >= 3 and spread else None


def score_replicates(
    rows: DataFrame, group: list[str], target: str, preds: list[str], metric: str, n_boot: int, seed: int, mode: str,
    groups: int = 1,
) -> DataFrame:
    """``(group, rep, scores)`` as from ``score_blocks``, each replicate of a group scored by one task.

    For groups known to be small enough for a task; ``groups`` says how many there are. Rows go to a few tasks each, never
    to one for every replicate.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shares = max(1, min(-(-cores // max(groups, 1)), n_boot))
    share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share")
    narrow = rows.select(*group, F.col("row_id").cast("string").alias("row_id"), "position", target, *preds, share)
    if mode == "exact":
        narrow = narrow.drop("row_id")
    narrow = narrow.repartitionByRange(min(groups * shares, 4 * cores) or 1, *group, "_share")
    schema = narrow.select(*group).schema.add("rep", T.IntegerType()).add("scores", T.ArrayType(T.DoubleType()))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("position").to_numpy())
        values = [table.column(c).to_numpy()[order] for c in (target, *preds)]
        keys = table.column("position").cast(pa.string()) if mode == "exact" else table.column("row_id")
        drawn = DrawBlocks(pc.take(keys, pa.array(order)).combine_chunks())
        n = len(order)
        if metric in VALUE_METRICS:
            parts = _value_parts(values[0], values[1:], metric)
        else:
            places = [np.unique(v, return_inverse=True)[1].astype(np.int32) for v in values]
        del values, table, keys
        reps, scores = [], []
        for rep, draws in drawn.numbers(seed, range(key[-1].as_py(), n_boot, shares)):
            if mode == "exact":
                counts = np.bincount(draws % np.uint32(n), minlength=n).astype(np.float64)
            else:
                counts = _poisson_counts(draws).astype(np.float64)
            total = counts.sum()
            if metric in VALUE_METRICS:
                found = [float(counts @ part) / total if total else None for part in parts]
                found = [f if f is None or metric != "rmse" else float(np.sqrt(f)) for f in found]
            else:
                ranks = []
                for place in places:
                    of_place = np.bincount(place, weights=counts)
                    ranks.append((np.cumsum(of_place) - of_place / 2 - total / 2)[place])
                found = [_rank_score(metric, counts, ranks[0], r) for r in ranks[1:]]
            reps.append(rep)
            scores.append(found)
        columns = {g: pa.repeat(k, len(reps)) for g, k in zip(group, key, strict=False)}
        columns |= {"rep": pa.array(reps, pa.int32()), "scores": pa.array(scores, pa.list_(pa.float64()))}
        return pa.table(columns)

    return narrow.groupBy(*group, "_share").applyInArrow(run, schema)


def score_partial_sums(
    rows: DataFrame, group: list[str], target: str, preds: list[str], metric: str, n_boot: int, seed: int
) -> DataFrame:
    """``(group, rep, scores)`` of a value metric under Poisson counts, from sums over the rows that a task has."""
    narrow = rows.select(*group, F.col("row_id").cast("string").alias("row_id"), target, *preds)
    schema = narrow.select(*group).schema.add("rep", T.IntegerType()).add("sums", T.ArrayType(T.DoubleType()))

    def made(totals: dict[tuple, np.ndarray]) -> Iterator[pd.DataFrame]:
        for key, total in totals.items():
            frame = {g: [k] * n_boot for g, k in zip(group, key, strict=True)}
            yield pd.DataFrame(frame | {"rep": np.arange(n_boot, dtype=np.int32), "sums": list(total)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for key, part in frame.groupby(group, sort=False):
                total = totals.setdefault(key, np.zeros((n_boot, 1 + len(preds))))
                values = _value_parts(part[target].to_numpy(), [part[p].to_numpy() for p in preds], metric)
                added = np.stack([np.ones(len(part)), *values], axis=1)
                for rep, draws in DrawBlocks(pa.array(part["row_id"], pa.string())).numbers(seed, range(n_boot)):
                    total[rep] += _poisson_counts(draws).astype(np.float64) @ added
            if len(totals) * n_boot > PARTIAL_SUMS:
                yield from made(totals)
                totals = {}
        yield from made(totals)

    sums = narrow.mapInPandas(run, schema)
    totals = [F.sum(F.get("sums", F.lit(k))).alias(f"_s{k}") for k in range(len(preds) + 1)]
    means = [F.try_divide(F.col(f"_s{k}"), F.col("_s0")) for k in range(1, len(preds) + 1)]
    scores = F.array(*[F.sqrt(m) if metric == "rmse" else m for m in means]).alias("scores")
    return sums.groupBy(*group, "rep").agg(*totals).select(*group, "rep", scores)


def _replicate_scores(
    rows: DataFrame, group: list[str], target: str, preds: list[str], metric: str, n_boot: int, seed: int, mode: str,
    spacing: int,
) -> DataFrame:
    """``(group, rep, scores)`` of a value or rank metric, the way that the size of the groups asks for."""
    if metric in VALUE_METRICS and mode == "poisson":
        return score_partial_sums(rows, group, target, preds, metric, n_boot, seed)
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n")).first()
    if (sizes[1] or 0) <= STRETCHES * spacing:
        return score_replicates(rows, group, target, preds, metric, n_boot, seed, mode, sizes[0])
    drawn = resample_blocks(rows, group, [target, *preds], n_boot, seed, mode)
    return score_blocks(drawn, group, target, preds, metric, n_boot, spacing)


def _check(mode: str) -> None:
    if mode not in ("exact", "poisson"):
        raise ValueError(f"mode must be 'exact' or 'poisson', got {mode!r}")


def bootstrap_ci(
    df: DataFrame,
    row_id: str,
    target: str,
    pred: str,
    metric: str = "spearman",
    group: list[str] | None = None,
    n_boot: int = 1000,
    alpha: float = 0.05,
    seed: int = 42,
    mode: str = "exact",
    spacing: int = SPACING,
) -> DataFrame:
    """Point value and percentile interval of a metric, per group; undefined replicates are ignored."""
    keys = group or ["_all"]
    base = df if group else df.withColumn("_all", F.lit(0))
    _check(mode)
    rows = _positions(base, keys, row_id, [target, pred], spacing)
    whole = rows.groupBy(*keys, target, pred).agg(F.count(F.lit(1)).alias("cnt"))
    point = score_cells(whole, keys, target, pred, (metric,), spacing)
    if metric not in PAIR_METRICS:
        scores = _replicate_scores(rows, keys, target, [pred], metric, n_boot, seed, mode, spacing)
        scores = scores.select(*keys, "rep", F.get("scores", F.lit(0)).alias(metric))
    else:
        reps = resample(rows, keys, [target, pred], n_boot, seed, mode)
        scores = score_cells(reps, [*keys, "rep"], target, pred, (metric,), spacing)
    levels = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    bounds = scores.groupBy(*keys).agg(F.percentile(metric, levels).alias("q"))
    out = point.join(bounds, keys, "left").select(
        *keys,
        F.lit(metric).alias("metric"),
        F.col(metric).alias("point"),
        F.get("q", F.lit(0)).alias("ci_lo"),
        F.get("q", F.lit(1)).alias("ci_hi"),
        F.lit(mode).alias("mode"),
    )
    return out if group else out.drop("_all")


def paired_bootstrap_diff(
    df: DataFrame,
    row_id: str,
    target: str,
    pred_full: str,
    pred_variant: str,
    metric: str = "spearman",
    group: list[str] | None = None,
    n_boot: int = 2000,
    seed: int = 42,
    mode: str = "exact",
    spacing: int = SPACING,
) -> DataFrame:
    """Full minus variant on the same rows and the same resamples, turned so that + favours full.

    ``p_full_not_better`` is the share of replicates with a difference of at most 0; a replicate
    without a value counts as none of those but stays in the denominator.
    """
    keys = group or ["_all"]
    base = df if group else df.withColumn("_all", F.lit(0))
    values = [target, pred_full, pred_variant]
    _check(mode)
    rows = _positions(base, keys, row_id, values, spacing)

    def differences(weighted: DataFrame, by: list[str]) -> DataFrame:
        sides = F.array(
            F.struct(F.lit(True).alias("full"), F.col(pred_full).alias("p")),
            F.struct(F.lit(False).alias("full"), F.col(pred_variant).alias("p")),
        )
        stacked = weighted.select(*by, F.col(target).alias("t"), "cnt", F.explode(sides).alias("s"))
        stacked = stacked.select(*by, "t", "cnt", "s.*")
        scores = score_cells(stacked, [*by, "full"], "t", "p", (metric,), spacing)
        full = F.max(F.when(F.col("full"), F.col(metric)))
        variant = F.max(F.when(~F.col("full"), F.col(metric)))
        return scores.groupBy(*by).agg(favour(full, variant).alias("delta"))

    def favour(full: Column, variant: Column) -> Column:
        return full - variant if metric in HIGHER_IS_BETTER else variant - full

    point = differences(rows.withColumn("cnt", F.lit(1).cast("long")), keys)
    if metric not in PAIR_METRICS:
        scores = _replicate_scores(rows, keys, target, [pred_full, pred_variant], metric, n_boot, seed, mode, spacing)
        delta = favour(F.get("scores", F.lit(0)), F.get("scores", F.lit(1)))
        deltas = scores.select(*keys, delta.alias("delta"))
    else:
        deltas = differences(resample(rows, keys, values, n_boot, seed, mode), [*keys, "rep"])
    not_better = F.sum(F.when(F.col("delta") <= 0, 1).otherwise(0)) / F.lit(n_boot)
    bounds = deltas.groupBy(*keys).agg(
        F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
        not_better.alias("p_full_not_better"),
    )
    out = point.join(bounds, keys, "left").select(
        *keys,
        "delta",
        F.get("q", F.lit(0)).alias("ci_lo"),
        F.get("q", F.lit(1)).alias("ci_hi"),
        "p_full_not_better",
        F.lit(mode).alias("mode"),
    )
    return out if group else out.drop("_all")
