"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt to shards of bounded size; queries, in blocks, meet every shard. In a shard each component is a
list of candidates sorted by value. A query reads its lists step by step from their favourable ends and keeps for each
candidate a lower bound (what was read, and the worst for the rest) and an upper one (and the next unread value for the
rest). It stops when only few candidates can still qualify; their final scores are resolved and the best of every shard
are merged. The queries of a block read in step, so that bounds are matrix products.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from textgrade.sources.settled import settle

#: Rows of a shard, and of a block of queries, on average.
SHARD, QUERIES = 4096, 1024
#: Scores end below this.
LONG = 2.0**63


def usable(vector: Column) -> Column:
    """Neither null nor holding anything null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def matrix(vectors, width: int, kind=np.float64) -> np.ndarray:
    """Rows of equal length; shorter vectors are filled up with zeros."""
    out = np.zeros((len(vectors), width), dtype=kind)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def nra(values: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """For each query the rows of ``values`` that may be among its best ``k``, by sequential reads of the sorted lists.

    All queries read on together: after ``depth`` reads a row's value in a list is known if it is among the list's
    ``depth`` largest (for a positive weight) or smallest ones (for a negative weight). Both bounds are products of
    what is known, and of what is not, with the weights. A query stops when few rows are left that can qualify.
    """
    n = len(values)
    value = values.astype(np.float64)
    order = np.argsort(value, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    ascending = np.take_along_axis(value, order, axis=0)
    found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(queries)
    left, depth = np.arange(len(queries)), max(1, n // 8)
    while len(left):
        weight = queries[left].T.astype(np.float64)
        sides = (
            (np.maximum(weight, 0), rank >= n - depth, ascending[max(n - depth - 1, 0)], ascending[0]),
            (np.minimum(weight, 0), rank < depth, ascending[min(depth, n - 1)], ascending[-1]),
        )
        known = sum((value * read) @ w for w, read, _, _ in sides)
        lower = upper = known
        if depth < n:
            upper = known + sum(~read @ (w * following[:, None]) for w, read, following, _ in sides)
            lower = known + sum(~read @ (w * worst[:, None]) for w, read, _, worst in sides)
        slack = 1e-9 * (np.abs(upper).max(axis=0) + 1)
        mine = ids[:, None] == own[left][None, :]
        bar = np.where(mine, -np.inf, np.minimum(lower, LONG))  # beyond the range of a long scores are equal
        bar = np.partition(bar, n - k, axis=0)[n - k] if n > k else np.full(len(left), -np.inf)
        alive = ~mine & (upper >= bar - slack)
        ended = (alive.sum(axis=0) <= max(64, 4 * k)) | (depth == n)
        for at in np.flatnonzero(ended).tolist():
            found[left[at]] = np.flatnonzero(alive[:, at])
        left, depth = left[~ended], min(n, 2 * depth)
    return found


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond the range of a long they count as its ends."""
    scores = rows @ query  # right modulo 2^64, so right wherever the product fits
    rough = rows.astype(float) @ query.astype(float)
    whole = np.abs(rows.astype(float)) @ np.abs(query.astype(float))
    for at in np.flatnonzero(np.abs(rough) + 1e-9 * whole >= LONG).tolist():
        true = sum(a * b for a, b in zip(rows[at].tolist(), query.tolist(), strict=True))
        scores[at] = max(-(1 << 63), min((1 << 63) - 1, true))
    return scores


def _search(k: int):
    def run(near: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 3), dtype=np.int64)]
        if len(near) and len(far):
            width = max(map(len, [*near["v"], *far["v"]]))
            values, queries = (matrix(side["v"], width, np.int64) for side in (near, far))
            ids, own = near["id"].to_numpy(), far["id"].to_numpy()
            several = len(np.unique(ids)) < len(ids)
            for low in range(0, len(own), 256):
                mine, asked = own[low : low + 256], queries[low : low + 256]
                # rows that share an id are one candidate with its best score, so none may be ruled out before
                rows = [np.flatnonzero(ids != q) for q in mine] if several else nra(values, ids, asked, mine, k)
                for query_id, query, some in zip(mine.tolist(), asked, rows, strict=True):
                    scores = products(values[some], query)
                    best = np.lexsort((ids[some], ~scores))  # falling; the least long has no negative
                    if several:
                        _, first = np.unique(ids[some][best], return_index=True)
                        best = best[np.sort(first)]
                    best = best[:k]
                    out.append(np.stack([np.full(len(best), query_id), ids[some][best], scores[best]], axis=1))
        return pd.DataFrame(np.concatenate(out), columns=["query_id", "vec_id", "score"])

    return run


def top_products(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` the ``k`` best others.

    Components become floor(``scale`` * x); the score is the integer inner product, ties go to the smaller id. Vectors
    that are null or hold null or non-finite components take no part, and neither do rows without an id. Shorter
    vectors count as filled up with zeros. Rows that repeat an id are one candidate, or one query, with the best of
    their scores. A component or score beyond the range of a long counts as its nearer end. An empty table gives an empty result; other columns are ignored.
    """
    vector = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & usable(vector)).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )
    rows = settle(rows.distinct())
    found = rows.agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).first()
    shards, blocks = (max(1, -(-n // size)) for n, size in ((found["n"], SHARD), (found["q"], QUERIES)))

    def all_of(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    own = lambda count: F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int")
    left = rows.select("id", "v", own(shards).alias("shard"), all_of(blocks).alias("block"))
    right = rows.where(F.col("id") % every == 0).select("id", "v", own(blocks).alias("block"), all_of(shards).alias("shard"))
    near = (
        left.groupBy("shard", "block")
        .cogroup(right.groupBy("shard", "block"))
        .applyInPandas(_search(k), "query_id long, vec_id long, score long")
    )
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


TOP_SQL = """
with v as (
  select vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum([q.v[i] * c.v[i] for i in range(1, len(q.v) + 1)])::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
