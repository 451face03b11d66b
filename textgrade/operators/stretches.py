"""Work on one stretch of range-partitioned rows: the Arrow functions behind ranks and pair sums.

Spark cuts the rows of all groups into ordered stretches of a bounded number of rows. What happens inside a
stretch is done here, on arrays; what crosses the cuts is put together by Spark from few rows a stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from textgrade.sources.settled import settle

#: Rows of which equal ones become one at a time, and rows in a stretch on average.
SLICE, STRETCH = 2**18, 2**17


def _merged(table: pa.Table, keys: list[str]) -> pa.Table:
    """Rows of equal keys as one, with the sum of ``cnt``."""
    summed = table.group_by(keys, use_threads=False).aggregate([("cnt", "sum")])
    return pa.table({k: summed[k] for k in keys} | {"cnt": summed["cnt_sum"]})


def written_cells(df: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """The written table ``(group, values, cnt)`` in which rows that are equal and near each other are one.

    Equal rows are merged a slice at a time, so a task holds a slice whatever the number of different rows, and a
    hot row is left once a slice. Whoever needs every cell once merges what is left.
    """
    keys = [*group, *values]
    # as when grouping by them: the two zeros are one value
    plain = [(F.col(k) + F.lit(0.0)).alias(k) if t == "double" else F.col(k) for k, t in df.select(*keys).dtypes]
    count = F.col("cnt") if "cnt" in df.columns else F.lit(1)
    rows = df.select(*plain, count.cast("long").alias("cnt"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SLICE:
                yield from _merged(pa.Table.from_batches(held), keys).to_batches()
                held, size = [], 0
        if held:
            yield from _merged(pa.Table.from_batches(held), keys).to_batches()

    return settle(rows.mapInArrow(merge, rows.schema))


def stretched(
    rows: DataFrame, order: list, count: int, work: Callable[[pa.Table], pa.Table], schema: T.StructType, merge: list[str] | None = None
) -> DataFrame:
    """Written results of ``work`` on each of ``count`` stretches of ``rows`` by ``order``; column ``_stretch`` tells which.

    With ``merge`` equal rows become one first; the order must tell rows with other such keys apart.
    """
    cut = rows.repartitionByRange(count, *order).withColumn("_stretch", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            yield from work(_merged(table, [*merge, "_stretch"]) if merge else table).to_batches()

    return settle(cut.mapInArrow(run, schema))


def in_order(table: pa.Table, keys: list[tuple[str, str]]) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=keys)).combine_chunks()


def _begins(table: pa.Table, names: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it in some of the columns; true for the first row."""
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for name in names:
        column = table[name].combine_chunks()
        differs = pc.not_equal(column[1:], column[:-1])
        if pa.types.is_floating(column.type):
            odd = pc.is_nan(column)
            differs = pc.and_not(differs, pc.and_(odd[1:], odd[:-1]))
        new[1:] |= differs.to_numpy(zero_copy_only=False).astype(bool)
    return new


def _spans(new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every row the first row of its run, the row after its run, and the number of the run."""
    first = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    after = np.append(first[1:], len(new))
    return first[number], after[number], number


def ranks_of(group: list[str], value: str) -> Callable[[pa.Table], pa.Table]:
    """Rank facts of a stretch, as if it were alone; ``_mark`` is 1 on the first row of its first run of equal
    values and 2 on that of its last one (3: the same)."""

    def work(table: pa.Table) -> pa.Table:
        table = in_order(table, [(k, "ascending") for k in [*group, value]])
        of_group = _begins(table, group)
        of_run = of_group | _begins(table, [value])
        g_first, g_after, _ = _spans(of_group)
        r_first, r_after, number = _spans(of_run)
        total = np.concatenate([[0], np.cumsum(table["cnt"].to_numpy())])
        mark = np.zeros(table.num_rows, dtype=np.int32)
        mark[0] += 1
        mark[r_first[-1]] += 2
        facts = {
            "_before": total[r_first] - total[g_first],
            "_run": total[r_after] - total[r_first],
            "_rows": total[g_after] - total[g_first],
            "_place": number - number[g_first],
            "_places": number[g_after - 1] - number[g_first] + 1,
        }
        for name, fact in facts.items():
            table = table.append_column(name, pa.array(fact.astype(np.int64)))
        return table.append_column("_mark", pa.array(mark))

    return work


def sums_both_ways(new: np.ndarray, place: np.ndarray, left: list[np.ndarray], right: list[np.ndarray]) -> list:
    """Per group the sum over pairs of ``left`` of the earlier row times ``right`` of the later one, over the pairs
    whose later row has the larger place; summed over the lists.

    Rows lie group by group, rows of one group where ``new`` begins it. Two places differ first at one bit, so every
    bit, from the highest on, sees a pair once, among the rows that share the bits above it.
    """
    firsts = np.flatnonzero(new)
    begin, end, _ = _spans(new)
    result = [0] * len(firsts)
    index = np.arange(len(place))
    for bit in reversed(range(int(place.max()).bit_length())):
        low = (place >> bit & 1) == 0
        for a, b in zip(left, right):
            below = np.concatenate([a[:1] * 0, np.cumsum(np.where(low, a, 0))])
            found = np.where(low, 0, b * (below[index] - below[begin]))
            result = [r + s for r, s in zip(result, np.add.reduceat(found, firsts).tolist())]
        zeros = np.concatenate([[0], np.cumsum(low)])
        inside = zeros[index] - zeros[begin]
        middle = begin + zeros[end] - zeros[begin]
        to = np.where(low, begin + inside, middle + index - begin - inside)
        begin, end = np.where(low, begin, middle), np.where(low, middle, end)
        back = np.empty_like(to)
        back[to] = index
        place, begin, end = place[back], begin[back], end[back]
        left, right = [a[back] for a in left], [b[back] for b in right]
    return result


def pair_sums_of(
    group: list[str], x: str, y: str, left: list[str], right: list[str], keep: list[str], falling: str = "descending"
) -> Callable[[pa.Table], pa.Table]:
    """The columns ``keep`` of a stretch, and on the first row of each group ``_total``, the sum as text."""

    def work(table: pa.Table) -> pa.Table:
        table = in_order(table, [*[(g, "ascending") for g in group], (y, "ascending"), (x, falling)])
        new = _begins(table, group)
        place = np.unique(table[x].to_numpy(), return_inverse=True)[1]
        a, b = ([table[c].to_numpy() for c in side] for side in (left, right))
        firsts = np.flatnonzero(new)
        if all(v.dtype.kind == "i" for v in a + b):
            # Whole numbers stay exact: beyond 62 bits they are Python's.
            if sum(float(abs(v).sum()) for v in a) * sum(float(abs(v).sum()) for v in b) >= 2.0**62:
                a, b = ([v.astype(object) for v in side] for side in (a, b))
            sums = sums_both_ways(new, place, a, b)
        else:  # one group at a time, so that no group's numbers round those of another
            sums = []
            for i, j in zip(firsts, np.append(firsts[1:], len(new))):
                own = [[v[i:j] for v in side] for side in (a, b)]
                sums += sums_both_ways(new[i:j], np.unique(place[i:j], return_inverse=True)[1], *own)
        totals = np.full(table.num_rows, None, dtype=object)
        totals[firsts] = [repr(t) for t in sums]
        return table.select(keep).append_column("_total", pa.array(totals.tolist(), pa.string()))

    return work


def pair_sums(
    rows: DataFrame, group: list[str], x: str, y: str, left: list[str], right: list[str], spacing: int = STRETCH
) -> DataFrame:
    """``(group, total)``: the sum over pairs (i, j) of a group with x_i < x_j and y_i < y_j of left_i times right_j,
    summed over the columns of the lists. Groups without such pairs may be absent or 0; null groups have none.

    The rows are cut into stretches by y (then falling x), where the pairs inside a stretch are summed, and cut again
    by x (then falling first stretch), for pairs of one second but different first stretches. What is left are pairs
    that differ in both; they are pairs of the sums by both stretches, far fewer rows, and the same question again.
    Whole numbers give an exact sum.
    """
    for g in group:
        rows = rows.where(F.col(g).isNotNull())
    weights = [*left, *right]
    exact = all(t in ("bigint", "int") for c, t in rows.dtypes if c in weights)
    kind = "decimal(38,0)" if exact else "double"
    rows = settle(rows.select(*group, x, y, *dict.fromkeys(weights)))
    found = []
    while True:
        n = rows.count()
        # At most about the root of n, so that the table of both stretches has at most half of the rows.
        count = 1 if n <= max(spacing, 64) else min(-(-n // spacing), int((n / 2) ** 0.5))
        keep = [*group, x, *dict.fromkeys(weights), "_stretch"]
        types = rows.withColumn("_stretch", F.spark_partition_id()).withColumn("_total", F.lit(None).cast("string"))
        order = [*group, F.col(y).asc(), F.col(x).desc()]
        first = stretched(rows, order, count, pair_sums_of(group, x, y, left, right, keep), types.select(*keep, "_total").schema)
        found.append(first.where("_total is not null").select(*group, F.col("_total").cast(kind)))
        if count == 1:
            break
        # Only groups in several stretches have pairs left: fewer than there are cuts.
        cuts = first.groupBy(*group).agg(F.min("_stretch").alias("_a"), F.max("_stretch").alias("_b")).where("_a < _b")
        rest = first.withColumnRenamed("_stretch", "_y").drop("_total")
        if group:
            rest = rest.join(F.broadcast(settle(cuts.select(*group))), group, "left_semi")
        elif cuts.isEmpty():
            break
        keep = [*group, "_y", *dict.fromkeys(weights), "_stretch"]
        types = rest.withColumn("_stretch", F.spark_partition_id()).withColumn("_total", F.lit(None).cast("string"))
        order = [*group, F.col(x).asc(), F.col("_y").desc()]
        # Sums do not mind which way is which; equal first stretches are told apart by falling x.
        work = pair_sums_of(group, x, "_y", left, right, keep)
        second = stretched(rest, order, count, work, types.select(*keep, "_total").schema)
        found.append(second.where("_total is not null").select(*group, F.col("_total").cast(kind)))
        sums = [F.sum(c).alias(c) for c in dict.fromkeys(weights)]
        rows = settle(second.groupBy(*group, F.col("_stretch").alias("_x"), "_y").agg(*sums))
        x, y = "_x", "_y"
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy(*group).agg(F.sum("_total").alias("total"))
