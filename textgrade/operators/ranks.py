"""Ranks, running totals and exact quantiles that hold when one group has most of the rows.

A window partitioned by the group alone puts a whole group on one task. Here the ordered cells of
all groups are range-partitioned into *stretches* and written once. Each stretch is its own window
partition, and a small table of stretch totals supplies what came before.

The number of stretches follows from the number of cells, so a stretch stays as long as it is at
any table size. The cells are written before they are cut: the sampling that Spark cuts by then
reads a table, and a repeated or lost task sees the same stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textgrade.functions.numbers import as_number
from textgrade.operators.stretches import STRETCH, ranks_of, stretched, written_cells
from textgrade.sources.settled import is_small, settle

# Cells in a stretch, on average.
SPACING = 2**20


def running_totals(
    cells: DataFrame,
    group: list[str],
    order: list[str],
    counters: list[str],
    spacing: int | None = SPACING,
    with_all: bool = True,
) -> DataFrame:
    """Add ``before_<c>`` (sum over smaller keys) and ``all_<c>`` (group sum) for each counter.

    ``(group, order)`` must be a key of ``cells``, so aggregate equal keys first. ``spacing`` None
    is for a caller who has counted the groups and found them small.
    """
    summed = counters if with_all else []
    keys = [*group, *order]
    stretches = 1
    if spacing:
        cells = settle(cells)
        stretches = -(-cells.count() // spacing)
    lead_in = [F.col(g) for g in group] or [F.lit(0)]
    earlier = (Window.unboundedPreceding, -1)
    none = F.lit(0)
    if stretches <= 1:
        inside = Window.partitionBy(*lead_in).orderBy(*order).rowsBetween(*earlier)
        whole = Window.partitionBy(*lead_in)
        return cells.select(
            "*",
            *[F.coalesce(F.sum(c).over(inside), none).alias(f"before_{c}") for c in counters],
            *[F.sum(c).over(whole).alias(f"all_{c}") for c in summed],
        )
    placed = settle(cells.repartitionByRange(stretches, *keys).withColumn("_stretch", F.spark_partition_id()))
    part = ["_stretch", *group]
    inside = Window.partitionBy(*part).orderBy(*order).rowsBetween(*earlier)
    totals = placed.groupBy(*part).agg(*[F.sum(c).alias(f"_sum_{c}") for c in counters])
    of_group = Window.partitionBy(*lead_in)
    done = of_group.orderBy("_stretch").rowsBetween(*earlier)
    offsets = totals.select(
        *part,
        *[F.coalesce(F.sum(f"_sum_{c}").over(done), none).alias(f"_off_{c}") for c in counters],
        *[F.sum(f"_sum_{c}").over(of_group).alias(f"all_{c}") for c in summed],
    )
    counted = placed.select(
        "*", *[F.coalesce(F.sum(c).over(inside), none).alias(f"_in_{c}") for c in counters]
    )
    # groups may be null, and a null group is one like any other
    there = offsets.withColumnsRenamed({p: f"_of_{p}" for p in part})
    match = F.lit(True)
    for p in part:
        match = match & F.col(p).eqNullSafe(F.col(f"_of_{p}"))
    return counted.join(there, match).select(
        *cells.columns,
        *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"before_{c}") for c in counters],
        *[F.col(f"all_{c}") for c in summed],
    )


def value_ranks(
    df: DataFrame, group: list[str], value: str, weight: str | None = None, spacing: int = SPACING
) -> DataFrame:
    """One row per distinct ``(group, value)`` with the rank facts of that value.

    ``avg_rank`` shares the average rank among ties, ``place`` counts distinct smaller values,
    ``places`` distinct values, ``rows`` all rows of the group and ``cnt`` those of the value.
    Null values and null groups have no rank.
    """
    present = df.where(F.col(value).isNotNull())
    for g in group:
        present = present.where(F.col(g).isNotNull())
    count = F.count(F.lit(1)) if weight is None else F.sum(weight)
    cells = present.groupBy(*group, value).agg(count.alias("cnt")).withColumn("one", F.lit(1))
    ranked = running_totals(cells, group, [value], ["cnt", "one"], spacing)
    return ranked.select(
        *group,
        value,
        "cnt",
        (F.col("before_cnt") + (F.col("cnt") + 1) / 2).alias("avg_rank"),
        F.col("before_one").cast("long").alias("place"),
        F.col("all_one").cast("long").alias("places"),
        F.col("before_cnt").alias("before"),
        F.col("all_cnt").alias("rows"),
    )


def percentile_within_corpus(
    df: DataFrame,
    label_col: str = "native_label",
    corpus_col: str = "corpus",
    polarity: dict[str, bool] | bool = True,
    out_col: str = "harmonized_difficulty",
    spacing: int = SPACING,
) -> DataFrame:
    """Average-tie percentile rank of the label inside its corpus, turned so that up is harder.

    A corpus with polarity False gets ``1 - rank``; one that the map does not name counts as True.
    """
    label = as_number(F.col(label_col))
    work = df.withColumn("_label", label)
    ranks = value_ranks(
        work.select(F.col(corpus_col).alias("_corpus"), "_label"), ["_corpus"], "_label",
        spacing=spacing,
    ).select("_corpus", F.col("_label").alias("_value"), (F.col("avg_rank") / F.col("rows")).alias("_rank"))
    if isinstance(polarity, dict):
        flipped = [name for name, harder_up in polarity.items() if not harder_up]
        turn = F.col(corpus_col).isin(flipped) if flipped else F.lit(False)
    else:
        turn = F.lit(not polarity)
    ranks = settle(ranks)
    work = work.drop(*[c for c in [out_col] if c in df.columns])
    same = (F.col(corpus_col) == F.col("_corpus")) & (F.col("_label") == F.col("_value"))
    if is_small(ranks):
        # the rows, with their texts, stay where they are
        joined = work.join(F.broadcast(ranks), same, "left")
    else:
        # Rows without a label match nothing; a hash keeps them from meeting on one task.
        spread = F.pmod(F.xxhash64("id" if "id" in df.columns else F.struct(*df.columns)), F.lit(1024))
        work = work.withColumn("_spread", F.when(F.col("_label").isNull(), spread + 1).otherwise(0))
        ranks = ranks.withColumn("_zero", F.lit(0).cast("long"))
        joined = work.join(ranks, same & (F.col("_spread") == F.col("_zero")), "left")
    difficulty = F.when(turn, 1 - F.col("_rank")).otherwise(F.col("_rank")).alias(out_col)
    keep = [c for c in df.columns if c != out_col]
    order = df.columns if out_col in df.columns else [*keep, out_col]
    return joined.select(*keep, difficulty).select(*order)


# Is a higher native label harder? Easiness scores run the other way.
POLARITY = {"clear": False, "onestop": True, "cefr": True}


def harmonize(
    df: DataFrame,
    method: str = "percentile",
    polarity: dict[str, bool] | bool = POLARITY,
    spacing: int = SPACING,
) -> DataFrame:
    """Fill the difficulty axis, its method name and a confidence of 1 where it has a value."""
    if method in ("band_table", "isotonic"):
        raise NotImplementedError(f"harmonization method {method!r} has no anchor tables")
    if method != "percentile":
        raise ValueError(f"unknown harmonization method {method!r}")
    ranked = percentile_within_corpus(df, polarity=polarity, spacing=spacing)
    return ranked.withColumns(
        {
            "mapping_method": F.lit("percentile_within_corpus"),
            "mapping_confidence": F.when(F.col("harmonized_difficulty").isNotNull(), F.lit(1.0)),
        }
    )


def unique_rank(
    df: DataFrame, order: list[str], group: list[str] | None = None, spacing: int = SPACING
) -> DataFrame:
    """Add ``rank`` 1..n by ``order`` (which must end in a key) and ``rows``, the group size."""
    group = group or []
    counted = running_totals(df.withColumn("_one", F.lit(1)), group, order, ["_one"], spacing)
    return counted.select(
        *df.columns,
        (F.col("before__one") + 1).cast("long").alias("rank"),
        F.col("all__one").cast("long").alias("rows"),
    )


def quantile_bin(rank: str, rows: str, bins: int) -> Column:
    """Quantile bin 0..bins-1 of a unique rank 1..rows: equal steps, upper edges closed."""
    step = f"(({rank} - 1) * {bins} + {rows} - 2) div greatest({rows} - 1, 1)"
    return F.expr(f"greatest({step}, 1) - 1").cast("int")


def exact_quantiles(
    df: DataFrame, group: list[str], value: str, levels: dict[str, float], spacing: int = SPACING
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per entry of ``levels``.

    Works from the rank table, so no task has to hold the values of a group.
    """
    ranks = value_ranks(df, group, value, spacing=spacing)

    def at(index: Column) -> Column:
        hit = (F.col("before") <= index) & (index < F.col("before") + F.col("cnt"))
        return F.max(F.when(hit, F.col(value)))

    columns = []
    for name, level in levels.items():
        spot = F.lit(level) * (F.col("rows") - 1)
        columns += [
            at(F.floor(spot)).alias(f"_lo_{name}"),
            at(F.ceil(spot)).alias(f"_hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_part_{name}"),
        ]
    found = ranks.groupBy(*group).agg(*columns)
    return found.select(
        *group,
        *[
            (
                F.col(f"_lo_{n}") + F.col(f"_part_{n}") * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))
            ).alias(n)
            for n in levels
        ],
    )


def joint_ranks(
    df: DataFrame, group: list[str], target: str, pred: str, spacing: int = SPACING
) -> DataFrame:
    """Re-rank target and prediction together inside each group.

    Gives the distinct ``(target, pred)`` cells of the rows that have both, with their row count
    ``cnt``, the counts and average ranks of either value, and the places used for counting pairs.
    Hot ties shrink, a slice of rows at a time, before anything is shuffled by value. A table that fits one
    task is ranked by windows; else cells are cut into stretches by either value in turn.
    """
    both = df.where(F.col(target).isNotNull() & F.col(pred).isNotNull())
    return ranks_of_cells(written_cells(both, group, [target, pred]), group, target, pred, spacing)


def ranks_of_cells(
    cells: DataFrame, group: list[str], target: str, pred: str, spacing: int = SPACING
) -> DataFrame:
    """``joint_ranks`` of written rows with a count ``cnt``, of which several may be one cell."""
    cells = cells.where(F.col(target).isNotNull() & F.col(pred).isNotNull())
    for g in group:  # as in value_ranks, a null group has no ranks
        cells = cells.where(F.col(g).isNotNull())
    cells = cells.select(*group, target, pred, "cnt")
    spacing = min(spacing, STRETCH)
    count = -(-cells.count() // spacing)
    if count <= 1:
        once = cells.groupBy(*group, target, pred).agg(F.sum("cnt").alias("cnt"))
        return _ranked_by_windows(settle(once), group, target, pred)
    by_target = _ranked_in_stretches(cells, group, target, pred, "t", count, merge=True)
    return _ranked_in_stretches(by_target, group, pred, target, "p", count)


def _ranked_in_stretches(
    cells: DataFrame, group: list[str], value: str, other: str, mark: str, count: int, merge: bool = False
) -> DataFrame:
    """Add ``cnt_``, ``rank_``, ``place_`` and ``places_<mark>`` of ``value``, and ``rows``, the rows of the group.

    A stretch knows the ranks of its cells but for what came before its first group, how its last group goes on, and
    runs of equal values that go over a cut. Those are at most its first and its last run: two rows a stretch, which are
    put together and sent to the cells.
    """
    names = [*group, value, other]
    kept = [*names, "cnt"] if merge else [c for c in cells.columns if c != "rows"]
    local = ["_before", "_run", "_rows", "_place", "_places"]
    typed = cells.select(*kept, F.spark_partition_id().alias("_stretch"), *[F.lit(0).cast("long").alias(c) for c in local], F.lit(0).alias("_mark"))
    work, columns = ranks_of(group, value), typed.columns

    def ranked(table):
        return work(table).select(columns)

    placed = stretched(cells.select(*kept), names, count, ranked, typed.schema, names if merge else None)
    edges = settle(placed.where("_mark > 0").select(*group, value, "_stretch", *local).coalesce(1))
    of_run = Window.partitionBy(*group, value)
    edges = edges.withColumns({"_from": F.min("_stretch").over(of_run), "_run": F.sum("_run").over(of_run)})
    # A run that came over the cut has been counted among the places of an earlier stretch.
    goes_on = F.max((F.col("_from") < F.col("_stretch")).cast("long"))
    spans = edges.groupBy(*group, "_stretch").agg(
        F.max("_rows").alias("_rows"), F.max("_places").alias("_places"), goes_on.alias("_twice")
    )
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    own = F.col("_places") - F.col("_twice")
    spans = settle(spans.select(
        *group, "_stretch",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_off"),
        (F.coalesce(F.sum(own).over(earlier), F.lit(0)) - F.col("_twice")).alias("_shift"),
        F.sum("_rows").over(whole).alias("_all_rows"),
        F.sum(own).over(whole).alias("_all_places"),
    ).coalesce(1))
    at = [*group, "_stretch"]
    runs = edges.where("_from = _stretch").join(spans, at).select(
        *group, value,
        (F.col("_off") + F.col("_before")).alias("_run_before"),
        F.col("_run").alias("_run_cnt"),
        (F.col("_shift") + F.col("_place")).alias("_run_place"),
    )
    moved = placed.join(F.broadcast(spans), at, "left").join(F.broadcast(settle(runs.coalesce(1))), [*group, value], "left")
    before = F.coalesce("_run_before", F.col("_before") + F.coalesce("_off", F.lit(0)))
    size = F.coalesce("_run_cnt", "_run")
    return moved.select(
        *kept,
        size.alias(f"cnt_{mark}"),
        (before + (size + 1) / 2).alias(f"rank_{mark}"),
        F.coalesce("_run_place", F.col("_place") + F.coalesce("_shift", F.lit(0))).alias(f"place_{mark}"),
        F.coalesce("_all_places", "_places").alias(f"places_{mark}"),
        F.coalesce("_all_rows", "_rows").alias("rows"),
    )


def _ranked_by_windows(cells: DataFrame, group: list[str], target: str, pred: str) -> DataFrame:
    """Joint ranks of cells known to be few."""
    whole = Window.partitionBy(*group)
    out = cells
    for value, mark in ((target, "t"), (pred, "p")):
        by = whole.orderBy(value)
        same = by.rangeBetween(Window.currentRow, Window.currentRow)
        upto = by.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.select(
            "*",
            F.sum("cnt").over(same).alias(f"cnt_{mark}"),
            F.sum("cnt").over(upto).alias("_upto"),
            (F.dense_rank().over(by) - 1).cast("long").alias(f"place_{mark}"),
        )
        middle = F.col("_upto") - F.col(f"cnt_{mark}") + (F.col(f"cnt_{mark}") + 1) / 2
        out = out.withColumn(f"rank_{mark}", middle).drop("_upto")
    return out.select(
        "*",
        (F.max("place_t").over(whole) + 1).alias("places_t"),
        (F.max("place_p").over(whole) + 1).alias("places_p"),
        F.sum("cnt").over(whole).alias("rows"),
    )


def adjacent_knots(df: DataFrame, x: str, y: str, spacing: int = SPACING) -> DataFrame:
    """Knots in ascending order, numbered from 1, each with the knot that follows it.

    Equal ``x`` become one knot with the mean ``y``; ``ties`` says how many rows it stands for.
    """
    clean = df.select(as_number(F.col(x)).alias("x"), as_number(F.col(y)).alias("y"))
    knots = (
        clean.where("x is not null and y is not null")
        .groupBy("x")
        .agg(F.min("y").alias("y"), F.count(F.lit(1)).alias("ties"))
    )
    ranked = unique_rank(knots, ["x"], spacing=spacing)
    following = ranked.select(
        (F.col("rank") - 1).alias("rank"), F.col("x").alias("next_x"), F.col("y").alias("next_y")
    )
    return ranked.join(following, "rank", "left").select(
        F.col("rank").alias("knot"), "x", "y", "ties", "rows", "next_x", "next_y",
        F.try_divide(F.col("next_y") - F.col("y"), F.col("next_x") - F.col("x")).alias("slope"),
    )
