"""Near-duplicate documents by min-max hashing.

Every permutation of the shingle hashes gives two signature values, its minimum and its maximum, so a signature of
``bands * rows`` values takes half as many hash evaluations. Bands of the signature are bucket keys. Texts that share
a bucket, directly or along a chain, form a candidate cluster; within a cluster every pair whose sizes allow it is
compared on the full sets, block against block, and only a spanning forest of the links leaves a task. A link is thus
missed only if its two signatures share no band at all: below 1e-7 at the threshold with the default bands.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textgrade.llm.common import broadcast_if_small, same
from textgrade.llm.components import components
from textgrade.llm.hashing import mix, shingle_sets, stretches
from textgrade.sources.settled import settle, settle_texts

BANDS, ROWS = 42, 5
#: Documents, and shingles, that a block of a cluster holds on average at most.
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1_000_000
_COLUMNS = 4096


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return seeds[:count] | np.uint64(1), seeds[count:]


def signature(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Minima and maxima of a non-empty set under ``ceil(bands * rows / 2)`` permutations."""
    count = -(-bands * rows // 2)
    factor, shift = _permutations(count)
    least = np.full(count, np.iinfo(np.uint64).max, dtype=np.uint64)
    most = np.zeros(count, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for low in range(0, len(shingles), 1024):
            value = factor[:, None] * shingles[None, low : low + 1024] + shift[:, None]
            np.minimum(least, value.min(axis=1), out=least)
            np.maximum(most, value.max(axis=1), out=most)
    return np.stack([least, most], axis=1).ravel()[: bands * rows]


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = signature(shingles, bands, rows).reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64)
        for k in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, k])
    return key.view(np.int64)


def _print(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int64, copy=False)))


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, keys = [], [], []
            for shingles in shingle_sets(batch.column("text"), width):
                sizes.append(len(shingles))
                prints.append(_print(shingles))
                keys.append(band_keys(shingles, bands, rows) if len(shingles) else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), _lists(keys)],
                names=["doc_id", "n_shingles", "print", "keys"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for part in stretches(batch.column("text")):
                sets = list(shingle_sets(part, width))
                prints = pa.array([_print(s) for s in sets], pa.binary())
                views = [s.view(np.int64) for s in sets]
                wanted = batch.column("wanted").slice(low, len(part))
                yield pa.RecordBatch.from_arrays([wanted, prints, _lists(views)], names=["wanted", "print", "shingles"])
                low += len(part)

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set of distinct values."""
    owner = np.concatenate([np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)])
    side = np.repeat([0, 1], [sum(map(len, left)), sum(map(len, right))])
    value = np.concatenate([*left, *right])
    _, place, uses = np.unique(value, return_inverse=True, return_counts=True)
    shared = uses[place] > 1
    _, place = np.unique(place[shared], return_inverse=True)
    owner, side = owner[shared], side[shared]
    order = np.argsort(place, kind="stable")
    owner, side, place = owner[order], side[order], place[order]
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, _COLUMNS):
        a, b = np.searchsorted(place, [low, low + _COLUMNS])
        width = int(place[b - 1]) - low + 1
        grids = []
        for k, rows in ((0, len(left)), (1, len(right))):
            mine = side[a:b] == k
            grid = np.zeros((rows, width), dtype=np.float32)
            grid[owner[a:b][mine], place[a:b][mine] - low] = 1
            grids.append(grid)
        total += (grids[0] @ grids[1].T).astype(np.int64)
    return total


def _forest(threshold: int):
    """Links of one block against another (or itself), without those that earlier ones imply."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["print", "side"])
        one, two = frame[frame["side"] != 2], frame[frame["side"] != 1]
        left, right = list(one["shingles"]), list(two["shingles"])
        found = []
        if left and right:
            common = shared_counts(left, right)
            sizes = [np.array([len(s) for s in side], dtype=np.int64) for side in (left, right)]
            union = sizes[0][:, None] + sizes[1][None, :] - common
            root: dict[bytes, bytes] = {}

            def top(x: bytes) -> bytes:
                while root.setdefault(x, x) != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            a, b = one["print"].tolist(), two["print"].tolist()
            for i, j in np.argwhere(100 * common >= threshold * union).tolist():
                p, q = top(a[i]), top(b[j])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    found.append((a[i], b[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def _block_pairs(members: DataFrame, threshold: int) -> DataFrame:
    """Members with ``places``: the block pairs (both bins, both block numbers, side) they are compared in.

    A cluster that fits a block is one place. A larger one is cut by set size into bins, of which only the same and
    adjacent ones can hold links, and bins by hash into blocks.
    """
    total = members.groupBy("cluster").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("mass"))
    big = settle(
        total.where((F.col("docs") > BLOCK_DOCS) | (F.col("mass") > BLOCK_SHINGLES)).select(
            "cluster", F.lit(True).alias("big")
        )
    )
    # a bin spans the size ratio at which links end; 1e-6 less, so that rounding cannot part a link by two bins
    span = math.log(100 / threshold) + 1e-6
    binned = members.join(broadcast_if_small(big), "cluster", "left").withColumn(
        "bin", F.when(F.col("big"), F.floor(F.log("n_shingles") / F.lit(span))).otherwise(F.lit(0)).cast("long")
    )
    blocks = binned.groupBy("cluster", "bin").agg(
        F.ceil(
            F.greatest(F.count("*") / F.lit(BLOCK_DOCS), F.sum("n_shingles") / F.lit(float(BLOCK_SHINGLES)))
        ).alias("blocks")
    )
    blocks = settle(blocks)
    around = blocks
    for name, step in (("below", 1), ("above", -1)):
        shifted = blocks.select("cluster", (F.col("bin") + step).alias("bin"), F.col("blocks").alias(name))
        around = around.join(shifted, ["cluster", "bin"], "left")
    around = settle(around.select("cluster", "bin", "blocks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("below", "above")]))
    own = F.pmod(F.xxhash64("print"), F.col("blocks"))

    def numbers(count):
        return F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<long>"))

    def place(low, high, first, second, side):
        names = ("low", "high", "first", "second", "side")
        return F.struct(*[c.cast("long").alias(n) for c, n in zip((low, high, first, second, side), names, strict=True)])

    bin_, k = F.col("bin"), F.col("own")
    inside = F.transform(
        numbers(F.col("blocks")),
        lambda j: place(bin_, bin_, F.least(k, j), F.greatest(k, j), F.when(k == j, 0).when(k < j, 1).otherwise(2)),
    )
    up = F.transform(numbers(F.col("above")), lambda j: place(bin_, bin_ + 1, k, j, F.lit(1)))
    down = F.transform(numbers(F.col("below")), lambda j: place(bin_ - 1, bin_, j, k, F.lit(2)))
    return (
        binned.join(broadcast_if_small(around), ["cluster", "bin"])
        .withColumn("own", own)
        .select("print", "cluster", F.concat(inside, up, down).alias("places"))
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    threshold: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept``.

    Two texts are linked if 100 * |intersection| >= threshold * |union| of their sets of ``width``-word shingles,
    words in lower case (A-Z). Texts without words are linked with nothing, and so are rows without an id (their
    component is null, they are kept). Rows that repeat an id each get the smallest id that their own text reaches.
    An empty table gives an empty result; other columns are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()
    sketches = settle_texts(
        source.mapInArrow(
            _sketches(width, bands, rows), f"doc_id {id_type}, n_shingles long, print binary, keys array<long>"
        )
    )
    named = sketches.where("n_shingles > 0 and doc_id is not null")
    classes = named.groupBy("print").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n_shingles")
    )

    keyed = named.select(F.xxhash64("print").alias("node"), F.explode("keys").alias("key"))
    shared = settle(
        keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last")
    ).select("key", "centre")
    # a text is tied to the least of its bucket centres, and so is each of the others: the same clusters, fewer links
    centres = keyed.join(broadcast_if_small(shared), "key").groupBy("node").agg(F.collect_set("centre").alias("centres"))
    tied = centres.select(F.explode(F.array_union("centres", F.array("node"))).alias("node"), F.array_min("centres").alias("centre"))
    clusters = components(tied.where("node != centre").distinct()).select("node", F.col("label").alias("cluster"))
    members = settle(classes.withColumn("node", F.xxhash64("print")).join(broadcast_if_small(clusters), "node").drop("node"))

    wanted = members.select(F.col("doc_id").alias("wanted_id"), F.col("print").alias("wanted"))
    full = source.join(broadcast_if_small(wanted), F.col("doc_id") == F.col("wanted_id")).select("text", "wanted")
    sets = full.mapInArrow(_sets(width), "wanted binary, print binary, shingles array<long>").where("wanted = print")
    placed = settle(_block_pairs(members, threshold)).select("print", "cluster", F.explode("places").alias("p"))
    links = settle_texts(
        placed.select("print", "cluster", "p.*")
        .join(sets.select("print", "shingles"), "print")
        .groupBy("cluster", "low", "high", "first", "second")
        .applyInPandas(_forest(threshold), "a binary, b binary")
    )
    linked = components(links).withColumnsRenamed({"node": "print", "label": "group"})
    grouped = members.join(broadcast_if_small(linked), "print").select("print", "group", "doc_id")
    least = grouped.groupBy("group").agg(F.min("doc_id").alias("least"))
    moved = settle(linked.join(least, "group").select(F.col("print").alias("moved"), "least"))
    reach = classes.join(broadcast_if_small(moved), F.col("print") == F.col("moved"), "left").select(
        "print", F.coalesce("least", "doc_id").alias("reach")
    )
    out = sketches.select("doc_id", "n_shingles", "print").join(
        settle(reach).withColumnRenamed("print", "class"),
        same(F.col("print"), F.col("class")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(),
        "left",
    )
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("reach", "doc_id"))
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest id stays.

    Of rows that repeat an id one stays; rows without an id stay. Columns are those of ``docs``.
    """
    found = settle(near_duplicates(docs, id_col, text_col, **how))
    named = found.where("doc_id is not null")
    ids = settle(
        named.groupBy("doc_id")
        .agg(F.count("*").alias("times"), F.max("kept").alias("kept"))
        .where("times > 1 or not kept")
        .select(F.col("doc_id").alias("_odd_id"), F.col("kept").alias("_odd_kept"))
    )
    odd = broadcast_if_small(ids)
    plain = docs.join(odd, docs[id_col] == F.col("_odd_id"), "left_anti")
    twice = broadcast_if_small(ids.where("_odd_kept").select("_odd_id"))
    repeated = docs.join(twice, docs[id_col] == F.col("_odd_id"), "left_semi").dropDuplicates([id_col])
    return plain.unionByName(repeated)
