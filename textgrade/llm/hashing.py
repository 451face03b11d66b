"""Word and shingle hashes of whole Arrow text columns, computed on their byte buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; a longer word makes its block longer.
BLOCK = 1 << 19
#: Bytes of texts whose words and sets are held at a time; a longer text is one stretch.
STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2^64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        steps = np.ones((2, max(n, BLOCK)), dtype=np.uint64)
        steps[0, 1:] = _BASE
        steps[1, 1:] = pow(_BASE, -1, 1 << 64)
        _powers[:] = list(np.multiply.accumulate(steps, axis=1))
    return _powers


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts and their bytes; a null counts as an empty text."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(n + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]]
    return bounds - bounds[0], bytes_


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the first of its words, and the 64-bit hash of every word in lower case (A-Z only)."""
    n = len(data)
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    starts, hashes = [], []
    low = 0
    while low < n:
        high = min(low + BLOCK, n)
        while high < n and not (_SPACE[data[high]] or first[high]):
            high += 1
        part = data[low:high]
        gap = _SPACE[part]
        edge = first[low : high + 1].copy()
        edge[0] = edge[-1] = True
        inside = ~gap
        begins = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], gap[:-1]))))
        ends = np.flatnonzero(inside & (edge[1:] | np.concatenate((gap[1:], [True])))) + 1
        power, inverse = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[part].astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        value = (sums[ends] - sums[begins]) * inverse[begins]
        starts.append(begins + low)
        hashes.append(mix(value + (ends - begins).astype(np.uint64)))
        low = high
    if not starts:
        return np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.uint64)
    at = np.concatenate(starts)
    return np.searchsorted(at, offsets), np.concatenate(hashes)


def stretches(column: pa.Array) -> Iterator[pa.Array]:
    """The column cut between texts, so that what is made of a part does not grow with the batch."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    low = 0
    while low < len(column):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + STRETCH, side="right")))
        yield column.slice(low, high - low)
        low = high


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text, as 64-bit hashes of ``width`` words in order.

    A text with fewer words has one shingle of all of them, one without words has none.
    """
    for part in stretches(column):
        first, hashes = words(*text_bytes(part))
        with np.errstate(over="ignore"):
            for low, high in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                n = min(width, high - low)
                if n == 0:
                    yield hashes[:0]
                    continue
                shingle = np.full(high - low - n + 1, n, dtype=np.uint64)
                for k in range(n):
                    shingle = mix(shingle * np.uint64(_BASE) + hashes[low + k : high - n + 1 + k])
                yield np.unique(shingle)
