"""Nearest reference vector, and the piecewise-linear map from labels to the difficulty axis."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from textgrade.functions.numbers import as_number, clip
from textgrade.operators.ranks import SPACING, adjacent_knots, running_totals
from textgrade.sources.settled import settle

# Bytes of vectors in a block: of gold that is broadcast, or of gold that is compared at a time.
BLOCK_BYTES = 64 * 2**20
# Bytes of vectors, as doubles, of either side that meet in one group beyond that; parts for idle cores are no smaller
# than the second.
GROUP_BYTES = 16 * 2**20
SMALLEST_GROUP = 2**20
# Reference rows compared at a time, and distances that a task holds.
BLOCK_ROWS = 4096
TILE_CELLS = 2**20
# Distances are compared at this many decimals, so that equal vectors tie in every layout.
DECIMALS = 9
# Knots up to this many are held by every task (16 bytes each).
BROADCAST_KNOTS = 200_000


def _unit(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype="float64") for v in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _closest(
    rows: np.ndarray, ids: np.ndarray, gold: np.ndarray, block_rows: int = BLOCK_ROWS
) -> tuple[np.ndarray, np.ndarray]:
    """Smallest cosine distance and its gold id; the smallest id wins a tie. Holds one tile of distances."""
    best = np.full(len(rows), np.inf)
    who = np.zeros(len(rows), dtype="int64")
    tile = max(TILE_CELLS // block_rows, 1)
    for low in range(0, len(rows), tile):
        part, nearest, place_of = rows[low : low + tile], best[low : low + tile], who[low : low + tile]
        every = np.arange(len(part))
        for at in range(0, len(gold), block_rows):
            likeness = part @ gold[at : at + block_rows].T
            most = likeness.max(axis=1)
            value = np.round(1.0 - most, DECIMALS)
            # the first that can round to the least distance; where it does not, all are rounded
            place = (likeness >= (most - 2 * 10.0**-DECIMALS)[:, None]).argmax(axis=1)
            other = np.flatnonzero(np.round(1.0 - likeness[every, place], DECIMALS) != value)
            if len(other):
                place[other] = np.round(1.0 - likeness[other], DECIMALS).argmin(axis=1)
            better = value < nearest
            nearest[better] = value[better]
            place_of[better] = place[better] + at
    return np.maximum(best, 0.0), ids[who]


def _matches(rows: pd.DataFrame, gold: pd.DataFrame, block_bytes: int) -> pd.DataFrame:
    """The nearest of some gold rows for each of some pool rows, with a block of gold at a time."""
    gold = gold.sort_values("neighbour", na_position="first")
    refs = _unit(gold["vector"])
    block_rows = min(max(block_bytes // max(refs[0].nbytes, 1), 1), BLOCK_ROWS)
    distance, neighbour = _closest(_unit(rows["vector"]), gold["neighbour"].to_numpy(), refs, block_rows)
    return pd.DataFrame({"row": rows["row"], "id": rows["id"], "neighbour": neighbour, "distance": distance})


def _search_one_block(rows: DataFrame, refs: DataFrame, schema: str) -> DataFrame:
    """Gold that was measured to fit one block goes to every task."""
    held = refs.toPandas().sort_values("neighbour", na_position="first")
    if not len(held):
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast((held["neighbour"].to_numpy(), _unit(held["vector"])))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for batch in batches:
            if len(batch):
                distance, neighbour = _closest(_unit(batch["vector"]), ids, matrix)
                yield pd.DataFrame({"id": batch["id"], "neighbour": neighbour, "distance": distance})

    return rows.mapInPandas(search, schema)


def _search_blocks(rows: DataFrame, refs: DataFrame, gold_bytes: int, block_bytes: int, schema: str) -> DataFrame:
    """Groups of the pool meet groups of gold in a cogroup, block by block; the least of a row's matches is kept.

    The size of a group bounds what a task holds and how often vectors are sent; it does not follow that of a block.
    """
    numbered = settle(rows.withColumn("row", F.monotonically_increasing_id()))
    cost = numbered.agg(F.sum(F.size("vector") * 8)).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-gold_bytes // GROUP_BYTES))
    # a part for every core, if they are not too small to be worth a task
    parts = max(1, -(-cost // GROUP_BYTES), min(cores, cost // SMALLEST_GROUP))
    left = numbered.withColumns(
        {"part": F.pmod(F.xxhash64("row"), F.lit(parts)), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}
    )
    right = refs.withColumns(
        {
            "block": F.pmod(F.xxhash64("neighbour", "vector"), F.lit(blocks)).cast("int"),
            "part": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))),
        }
    )

    def match(pool: pd.DataFrame, gold: pd.DataFrame) -> pd.DataFrame:
        if len(pool) and len(gold):
            return _matches(pool, gold, block_bytes)
        return pd.DataFrame({"row": [], "id": [], "neighbour": [], "distance": []})

    by = ["part", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(match, f"row long, {schema}")
    best = F.min(F.struct("distance", "neighbour")).alias("best")
    return found.groupBy("row").agg(F.first("id").alias("id"), best).select("id", "best.neighbour", "best.distance")


def nearest_gold(
    pool: DataFrame,
    gold: DataFrame,
    id_col: str = "id",
    vector_col: str = "embedding",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id, neighbour, distance)``: the closest gold row of every pool row by cosine distance.

    Ties go to the smaller gold id, null first; a zero vector is at distance 1 from everything. Null vectors count as missing:
    such rows have no neighbour and are none. Every other pool row gives one row, whether its id is null or repeated or not.
    Gold that is measured to fit one block is broadcast, and vectors of the pool stay where they are; beyond that blocks of
    both meet in a shuffle. The answer does not depend on the size of the blocks.
    """
    rows = pool.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    refs = gold.where(F.col(vector_col).isNotNull()).select(
        F.col(id_col).alias("neighbour"), F.col(vector_col).alias("vector")
    )
    types = dict(pool.select(id_col).dtypes), dict(gold.select(id_col).dtypes)
    schema = f"id {types[0][id_col]}, neighbour {types[1][id_col]}, distance double"
    cost = refs.agg(F.coalesce(F.sum(F.size("vector") * 8), F.lit(0))).first()[0]
    if cost <= block_bytes:
        return _search_one_block(rows, refs, schema)
    # copies of a gold row can only tie with it
    return _search_blocks(rows, refs.distinct(), cost, block_bytes, schema)


def _end_slopes(first, second, last, before) -> tuple[float, float]:
    """Slopes beyond the knots: 0 where an end label stands for several rows."""
    low = (second.y - first.y) / (second.x - first.x) if first.ties == 1 else 0.0
    high = (last.y - before.y) / (last.x - before.x) if last.ties == 1 else 0.0
    return low, high


def map_to_axis(
    df: DataFrame,
    gold: DataFrame,
    pred_col: str = "pred",
    out_col: str = "axis",
    extrapolate: bool = True,
    label_col: str = "native_label",
    difficulty_col: str = "harmonized_difficulty",
    broadcast_knots: int = BROADCAST_KNOTS,
    spacing: int = SPACING,
) -> DataFrame:
    """Carry predictions onto the difficulty axis along the gold labels' own relation.

    Linear between knots. Beyond the ends the outer slope goes on, so the result may leave [0, 1];
    without ``extrapolate``, or with fewer than two gold rows, it is clamped into [0, 1].
    """
    knots = adjacent_knots(gold, label_col, difficulty_col, spacing)
    knots = knots.select("knot", "x", "y", "ties", "next_x", "next_y", "slope")
    held = knots.limit(broadcast_knots + 1).toPandas().sort_values("knot")
    few = len(held) <= broadcast_knots
    if few:
        n, rows = len(held), int(held["ties"].sum())
        end = {r.knot: r for r in held.itertuples()}
    else:
        n, rows = knots.agg(F.count(F.lit(1)), F.sum("ties")).first()
        end = {r.knot: r for r in knots.where(F.col("knot").isin(1, 2, n - 1, n)).collect()}
    if n == 0:
        return df.withColumn(out_col, F.lit(None).cast("double"))
    open_ended = extrapolate and rows >= 2
    first, last = end[1], end[n]
    low = high = 0.0
    if open_ended and n > 1:
        low, high = _end_slopes(first, end[2], last, end[n - 1])
    p = as_number(F.col(pred_col))
    if few:
        shared = df.sparkSession.sparkContext.broadcast((held["x"].to_numpy(), held["y"].to_numpy()))

        @F.pandas_udf("double")
        def inside(values: pd.Series) -> pd.Series:
            x, y = shared.value
            return pd.Series(np.interp(values.to_numpy("float64"), x, y)).where(values.notna().to_numpy())

        between = df.withColumn("_between", inside(p))
    else:
        between = _between_by_join(df, knots, p, spacing)
    value = F.col("_between")
    if open_ended:
        value = (
            F.when(p < first.x, F.lit(first.y) + F.lit(low) * (p - F.lit(first.x)))
            .when(p > last.x, F.lit(last.y) + F.lit(high) * (p - F.lit(last.x)))
            .otherwise(value)
        )
    else:
        value = clip(value, 0.0, 1.0)
    return between.withColumn(out_col, value).drop("_between")


def _between_by_join(df: DataFrame, knots: DataFrame, p: Column, spacing: int) -> DataFrame:
    """Interpolation for knot tables too large to hand to every task.

    Knots and distinct predictions are put in one order; the running number of knots says which
    segment a prediction lies in, and that number is an ordinary join key.
    """
    rows = settle(df.withColumn("_p", p))
    wanted = rows.where("_p is not null").select(F.col("_p").alias("v"), F.lit(0).alias("knots"))
    points = wanted.unionByName(knots.select(F.col("x").alias("v"), F.lit(1).alias("knots")))
    points = points.groupBy("v").agg(F.sum("knots").alias("knots"))
    counted = running_totals(points, [], ["v"], ["knots"], spacing, with_all=False)
    place = counted.select("v", (F.col("before_knots") + F.col("knots")).alias("segment"))
    first = knots.where("knot = 1").select(
        F.lit(0).alias("knot"), "x", "y", F.lit(None).cast("double").alias("slope")
    )
    lines = knots.select("knot", "x", "y", "slope").unionByName(first)
    value = F.col("y") + F.coalesce(F.col("slope") * (F.col("v") - F.col("x")), F.lit(0.0))
    # One line per distinct prediction first, so hot segments are small before rows meet them.
    lookup = place.join(lines, F.col("segment") == F.col("knot")).select("v", value.alias("_between"))
    return rows.join(lookup, F.col("_p") == F.col("v"), "left").drop("_p", "v")
