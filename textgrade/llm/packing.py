"""Packing documents into sequences by vector best-fit.

A piece asks a sequence for tokens, one document, and attention cost (the square of its length). Pieces of one length
ask for the same, so the packing is planned on the number of pieces of each length, a table no longer than a sequence,
whatever the number of documents: longest first, each goes to the open sequence that fits best, sequences in the same
state being handled together. The plan says for runs of equally long pieces which sequences they go to; pieces are
numbered within their length without any sorting and read their places off the plan.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from textgrade.llm.common import broadcast_if_small
from textgrade.llm.tokenizers_ import default_path, ids_of
from textgrade.sources.settled import settle, settle_texts

CAPACITY = 2048


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence, the weights of the three, and how open sequences are scored.

    ``norm`` takes the least weighted norm of what is left, ``dot`` the greatest weighted product of what is left and
    what is asked for. The default documents and cost never close a sequence before its tokens do.
    """

    tokens: int = CAPACITY
    documents: int = CAPACITY
    cost: int = CAPACITY**2
    weights: tuple[float, float, float] = (1.0, 1 / 64, 1 / 64)
    score: str = "norm"


@dataclass(frozen=True)
class Run:
    """Pieces ``first`` .. ``first + count`` of one length: dealt in turn to ``bins`` sequences from ``bin`` on."""

    length: int
    first: int
    count: int
    bin: int
    bins: int
    offset: int


def plan_runs(pieces_by_length: dict[int, int], limits: Limits = Limits()) -> list[Run]:
    """Places for all pieces; the work depends on the number of lengths, not on the number of pieces."""
    full = np.array([limits.tokens, limits.documents, limits.cost], dtype=np.int64)
    weights = np.array(limits.weights)
    rests = np.zeros((64, 3), dtype=np.int64)  # of open sequences in the same state
    where: list[tuple[int, int]] = []  # their numbers: first and count
    runs: list[Run] = []
    opened = 0

    def add(rest: np.ndarray, first: int, count: int) -> None:
        nonlocal rests
        if len(where) == len(rests):
            rests = np.concatenate([rests, np.zeros_like(rests)])
        rests[len(where)] = rest
        where.append((first, count))

    for length in sorted(pieces_by_length, reverse=True):
        ask = np.array([length, 1, length * length], dtype=np.int64)
        if (ask > full).any():
            raise ValueError(f"a piece of {length} tokens does not fit an empty sequence")
        left, placed = pieces_by_length[length], 0
        while left:
            state = rests[: len(where)]
            fits = np.flatnonzero((state >= ask).all(axis=1))
            if len(fits):
                if limits.score == "dot":
                    values = -((state[fits] / full * (ask / full)) @ weights)
                else:
                    values = (((state[fits] - ask) / full) ** 2) @ weights
                best = int(fits[np.argmin(values)])
                rest, (first, count) = state[best].copy(), where[best]
                deep = 1 if limits.score == "dot" else int((rest // ask).min())
                deep = max(1, min(deep, left // count))
                used = min(count, left)
                if used < count:  # only some of them get one
                    add(rest, first + used, count - used)
                    where[best] = (first, used)
                rests[best] = rest - deep * ask
                offset = limits.tokens - int(rest[0])
                taken = deep * used
            else:
                deep = min(int((full // ask).min()), left)
                used = left // deep
                first, offset, taken = opened, 0, deep * used
                opened += used
                add(full - deep * ask, first, used)
            runs.append(Run(length, placed, taken, first, used, offset))
            placed += taken
            left -= taken
    return runs


def _cut(path: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows, numbers = [], []
            for k, text in enumerate(batch.column("text")):
                ids = np.append(ids_of(text.as_py() or "", path), end_id).astype("<u4")
                head = (len(ids) - 1) % size + 1
                start, piece = 0, 0
                for stop in range(head, len(ids) + 1, size):
                    length = stop - start
                    rows.append(k)
                    numbers.append((piece, start, length, zlib.crc32(ids[start:stop].tobytes()), seen[length]))
                    seen[length] += 1
                    start, piece = stop, piece + 1
            columns = np.array(numbers, dtype=np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array(columns[:, 0].astype(np.int32)),
                    *[pa.array(np.ascontiguousarray(columns[:, c])) for c in range(1, 5)],
                    pa.array(np.full(len(rows), part, dtype=np.int32)),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "place", "part"],
            )

    return run


def _deal(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, bin_, bins, offset = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 50) | rank, side="right") - 1
            nth = rank - first[at]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array(bin_[at] + nth % bins[at]),
                    pa.array(offset[at] + nth // bins[at] * length),
                ],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    limits: Limits = Limits(),
    end_id: int = 0,
) -> DataFrame:
    """Per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and ``end_id``; a null text is empty. Only one longer than a sequence is cut, into pieces
    that fill sequences and a shorter first one. ``ids_crc32`` is that of the piece's unsigned little-endian 32-bit
    ids. Rows that repeat an id are packed each for itself. An empty table gives an empty result; other columns are
    ignored. ``tokenizer`` is the path of the vocabulary on every worker.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    pieces = settle_texts(
        source.mapInArrow(
            _cut(tokenizer or default_path(), limits.tokens, end_id),
            f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, place long, part int",
        )
    )
    counts = settle(pieces.groupBy("part", "length").count())
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    runs = sorted(plan_runs(by_length, limits), key=lambda r: (r.length, r.first))
    columns = np.array([(r.length << 50 | r.first, r.first, r.bin, r.bins, r.offset) for r in runs], dtype=np.int64)
    plan = docs.sparkSession.sparkContext.broadcast(list(columns.reshape(-1, 5).T.copy()))

    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = settle(counts.select("part", "length", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base")))
    ranked = pieces.join(broadcast_if_small(bases), ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        _deal(plan), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
