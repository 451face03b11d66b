"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, differently for every curve, shifted at random, and put in Hilbert order:
Spark range-partitions the keys, which numbers the rows of each curve. Runs of neighbouring keys are blocks; a query
meets the blocks in a window around its own on every curve, and what these find is merged and ranked by the true
distance. Equal vectors are one point of the curves, with as many of their smallest ids as an answer can hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from textgrade.llm.common import broadcast_if_small
from textgrade.llm.topk import matrix, usable
from textgrade.sources.settled import settle

#: Curves, dimensions and bits of each, and the share of all points in a query's window on a curve. On vectors without
#: any structure (uniform directions in 64 dimensions) this gives a recall of about 0.96; where vectors are clustered
#: a much smaller window does.
CURVES, AXES, BITS, WINDOW = 8, 4, 12, 0.2
#: Points in a block, and blocks whose queries go together.
BLOCK, TOGETHER = 2048, 64
#: Rows, drawn by their hash, that projections are centred and scaled by.
SAMPLE = 20_000
#: Components beyond which squares may overflow, and the bound of projections.
LARGE, FAR = 1e150, 1e300


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of cells (rows of coordinates under 2^bits), by Gray-code rotations."""
    x = [cells[:, k].astype(np.int64) for k in range(cells.shape[1])]
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for k in range(n):
            high = (x[k] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if k:
                x[k] = x[k] ^ swap
        bit >>= 1
    for k in range(1, n):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip = np.where((x[n - 1] & bit) != 0, flip ^ (bit - 1), flip)
        bit >>= 1
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(n):
            key = (key << 1) | (((x[k] ^ flip) >> level) & 1)
    return key


def _axes(width: int, curve: int, axes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng([seed, curve])
    wide = draw.normal(size=(max(width, axes), axes))
    return np.linalg.qr(wide)[0][:width], draw.uniform(size=axes)


def _middle(vectors: np.ndarray, curves: int, axes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of every projection, and its spread by the median distance from it: single far points move neither."""
    centre, spread = np.zeros((curves, axes)), np.ones((curves, axes))
    if len(vectors):
        for curve in range(curves):
            y = _projected(vectors, _axes(vectors.shape[1], curve, axes, seed)[0])
            centre[curve] = np.median(y, axis=0)
            off = 1.4826 * np.median(np.abs(y - centre[curve]), axis=0)
            spread[curve] = np.where(off > 0, off, np.maximum(np.abs(y - centre[curve]).max(axis=0), 1e-300))
    return centre, spread


def _projected(rows: np.ndarray, turn: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.clip(np.nan_to_num(rows @ turn), -FAR, FAR)


def _keyed(width: int, curves: int, axes: int, bits: int, seed: int, centre: np.ndarray, spread: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = matrix(frame["v"], width)
            for curve in range(curves):
                turn, shift = _axes(width, curve, axes, seed)
                y = (_projected(rows, turn) - centre[curve]) / spread[curve] / 3
                cells = np.clip((y + 1 + shift) / 3, 0, 1 - 1e-9) * (1 << bits)
                yield frame.assign(curve=curve, key=hilbert_keys(cells, bits))[["curve", "key", "rep", "asked", "ids", "v"]]

    return run


def _numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, seen = TaskContext.get().partitionId(), 0
    for frame in frames:
        yield frame.assign(part=part, place=np.arange(seen, seen + len(frame)))[["part", "place", "rep", "asked", "ids", "v"]]
        seen += len(frame)


def distances(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances; where squares would overflow, in units of the largest difference."""
    with np.errstate(over="ignore", invalid="ignore"):
        apart = points - query
        most = np.abs(apart).max(axis=1, initial=0.0)
        unit = np.where(most > LARGE, most, 1.0)
        return unit * np.sqrt(((apart / unit[:, None]) ** 2).sum(axis=1))


def _nearest(k: int):
    """The ``k + 1`` nearest points of a block for each query (one of them may be the query itself)."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        left = left.drop_duplicates("rep")  # a block may hold the end of one curve and the start of the next
        if len(left) and len(right):
            width = max(map(len, [*left["v"], *right["w"]]))
            points = matrix(left["v"], width)
            reps, ids = left["rep"].to_numpy(), left["ids"].to_numpy()
            with np.errstate(over="ignore"):
                norms = np.where((np.abs(points) > LARGE).any(axis=1), np.inf, (points * points).sum(axis=1))
            for low in range(0, len(right), 256):
                part = right.iloc[low : low + 256]
                asked = matrix(part["w"], width)
                own = np.where(np.abs(asked) > LARGE, 0.0, asked)
                with np.errstate(over="ignore", invalid="ignore"):
                    rough = norms[None, :] - 2 * (asked @ points.T)
                rough[:, ~np.isfinite(norms)] = np.inf
                rough[(np.abs(asked) > LARGE).any(axis=1)] = 0.0  # squares that overflow: all points are compared
                most = min(k + 1, len(points))
                limit = np.partition(rough, most - 1, axis=1)[:, most - 1]
                scale = np.where(np.isfinite(rough), np.abs(rough), 0).max(axis=1) + (own * own).sum(axis=1) + 1
                for row, (query, bound) in enumerate(zip(part["q"].tolist(), limit + 1e-9 * scale, strict=True)):
                    rows = np.flatnonzero(rough[row] <= bound)
                    true = distances(points[rows], asked[row])
                    best = np.lexsort((reps[rows], true))[:most]
                    out.append(pd.DataFrame({"q": query, "c": reps[rows][best], "d": true[best], "ids": ids[rows][best]}))
        empty = {"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "d": pd.Series(dtype="float64"), "ids": pd.Series(dtype=object)}
        return pd.concat(out) if out else pd.DataFrame(empty)

    return run


def nearest_neighbours(
    vectors: DataFrame,
    every: int = 100,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = CURVES,
    axes: int = AXES,
    bits: int = BITS,
    window: float = WINDOW,
    block: int = BLOCK,
    seed: int = 8,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its ``k`` nearest found.

    The score is the Euclidean distance of the original vectors; ties go to the smaller id. Vectors that are null, all
    zero (or empty) or hold null or non-finite components take no part, and neither do rows without an id. Shorter
    vectors count as filled up with zeros. Rows that repeat an id are one candidate at its nearest, and one query that
    takes the nearest over its rows. An empty table gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    rows = vectors.where(
        F.col(id_col).isNotNull() & usable(vector) & F.exists(vector, lambda x: x != 0)
    ).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    rows = settle(rows.distinct())
    first = Window.partitionBy("v").orderBy("id")
    points = (
        rows.withColumn("nth", F.row_number().over(first))
        .where(F.col("nth") <= k + 1)
        .groupBy("v")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .select("v", "ids", F.xxhash64("v", F.col("ids")[0]).alias("rep"))
    )
    points = settle(points)
    asking = rows.where(F.col("id") % every == 0)
    named = points.select(F.col("v").alias("of"), F.col("rep").alias("q"))
    queries = settle(asking.join(named, F.col("of") == F.col("v")).select(F.col("id").alias("query_id"), "q"))
    asked = settle(queries.select("q").distinct())
    points = points.join(broadcast_if_small(asked), F.col("rep") == F.col("q"), "left").select(
        "rep", "ids", "v", F.col("q").isNotNull().alias("asked")
    )
    facts = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    count, width = facts["n"], facts["width"] or 1

    drawn = points.where(F.pmod("rep", F.lit(max(1, count // SAMPLE))) == 0).orderBy("rep").select("v").toPandas()["v"]
    centre, spread = _middle(matrix(drawn, width) if len(drawn) else np.zeros((0, width)), curves, axes, seed)

    point = "rep long, asked boolean, ids array<long>, v array<double>"
    keyed = points.mapInPandas(_keyed(width, curves, axes, bits, seed, centre, spread), f"curve int, key long, {point}")
    parts = max(spark.sparkContext.defaultParallelism, -(-count * curves // (32 * block)))
    ordered = settle(
        keyed.repartitionByRange(parts, "curve", "key", "rep")
        .sortWithinPartitions("curve", "key", "rep")
        .mapInPandas(_numbered, f"part int, place long, {point}")
    )
    sizes = ordered.groupBy("part").count()
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    bases = settle(sizes.select(F.col("part").alias("p"), F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base")))
    at = ordered.join(broadcast_if_small(bases), F.col("part") == F.col("p")).withColumn(
        "block", F.floor((F.col("base") + F.col("place")) / F.lit(block)).cast("long")
    )
    side = int(-(-(window * count / 2) // block))
    last = max(0, (count * curves - 1) // block)
    low, high = F.greatest(F.col("block") - side, F.lit(0)), F.least(F.col("block") + side, F.lit(last))
    group = lambda c: F.floor(c / F.lit(TOGETHER)).cast("long")
    left = at.select("rep", "ids", "v", "block", F.explode(F.sequence(group(low), group(high))).alias("group"))
    right = at.where("asked").select(
        F.col("rep").alias("q"), F.col("v").alias("w"), group(F.col("block")).alias("group"), F.explode(F.sequence(low, high)).alias("block")
    )
    near = (
        left.groupBy("block", "group")
        .cogroup(right.groupBy("block", "group"))
        .applyInPandas(_nearest(k), "q long, c long, d double, ids array<long>")
    )
    merged = near.groupBy("q", "c").agg(F.min("d").alias("d"), F.max("ids").alias("ids"))
    by_distance = Window.partitionBy("q").orderBy("d", F.col("ids")[0], "c")
    some = merged.withColumn("nth", F.row_number().over(by_distance)).where(F.col("nth") <= k + 1)
    answers = some.select("q", "d", F.explode("ids").alias("vec_id"))
    found = (
        queries.join(answers, "q")
        .where("query_id != vec_id")
        .groupBy("query_id", "vec_id")
        .agg(F.min("d").alias("score"))
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
