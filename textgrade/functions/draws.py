"""Reproducible draws: every random choice is a function of a seed and of row keys.

The value does not depend on partitioning or task retries, so a lost executor repeats the same
choice, and the SQL form in any other engine gives the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

DRAW_RANGE = 2**32


def draw_key(seed: int, *keys: Column | str) -> Column:
    """Hex digest that orders rows at random."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def draw_number(seed: int, *keys: Column | str) -> Column:
    """Whole number, uniform in [0, 2^32)."""
    return F.conv(F.substring(draw_key(seed, *keys), 1, 8), 16, 10).cast("long")


# Keys that are hashed side by side: their words stay in a core's cache. One MD5 block takes up to 55 bytes, of which
# seed and replicate may have 24.
_SIDE, _ONE_BLOCK, _HEAD = 16384, 55, 24
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint64).astype(np.uint32)
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]
_START = np.array([0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476], dtype=np.uint32)


def _md5_heads(words: list) -> np.ndarray:
    """First four bytes, as a number, of the MD5 of one-block messages given as 16 words (arrays or single numbers)."""
    a, b, c, d = _START
    for i in range(64):
        if i < 16:
            mixed, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            mixed, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            mixed, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            mixed, at = c ^ (b | ~d), 7 * i % 16
        mixed = mixed + a + (words[at] + _SINES[i])
        turn = _TURNS[i // 16][i % 4]
        a, b, c, d = d, b + ((mixed << np.uint32(turn)) | (mixed >> np.uint32(32 - turn))), b, c
    return (a + _START[0]).byteswap()


class DrawBlocks:
    """``draw_number(seed, rep, key)`` of many keys in one go, for replicates that share them inside a task.

    ``keys`` is an Arrow array of strings; a null key is left out of the digest, as ``concat_ws`` does.
    """

    def __init__(self, keys: pa.Array) -> None:
        self.size = len(keys)
        self._runs: list[tuple[np.ndarray, np.ndarray]] = []
        self._long: list[tuple[int, bytes]] = []
        for low in range(0, len(keys), _SIDE):
            tails = [b"" if k is None else b":" + k.encode() for k in keys.slice(low, _SIDE).to_pylist()]
            lengths = np.fromiter(map(len, tails), dtype=np.int64, count=len(tails))
            self._long += [(low + i, tails[i]) for i in np.flatnonzero(lengths > _ONE_BLOCK - _HEAD).tolist()]
            for length in np.unique(lengths[lengths <= _ONE_BLOCK - _HEAD]).tolist():
                at = np.flatnonzero(lengths == length)
                text = b"".join(tails[i] for i in at.tolist())
                self._runs.append((at + low, np.frombuffer(text, dtype=np.uint8).reshape(len(at), length)))

    def _messages(self, at: np.ndarray, tail: np.ndarray, head: int) -> list:
        """The words of messages whose first ``head`` bytes are still empty."""
        end = head + tail.shape[1]
        block = np.zeros((len(at), 64), dtype=np.uint8)
        block[:, head:end] = tail
        block[:, end] = 0x80
        block[:, 56:60] = np.frombuffer(np.uint32(8 * end).tobytes(), dtype=np.uint8)
        words = np.ascontiguousarray(block.view("<u4").T)
        return [w.copy() if head // 4 <= k <= end // 4 else w[:1].copy() for k, w in enumerate(words)]

    def numbers(self, seed: int, reps: range) -> Iterator[tuple[int, np.ndarray]]:
        """For every replicate the draws of all keys, in their order."""
        made: dict[int, list] = {}
        for rep in reps:
            head = f"{seed}:{rep}".encode()
            if len(head) not in made and len(head) <= _HEAD:
                made = {len(head): [self._messages(at, tail, len(head)) for at, tail in self._runs]}
            first = np.frombuffer(head.ljust(64, b"\0")[:64], dtype="<u4")
            out = np.empty(self.size, dtype=np.uint32)
            if len(head) <= _HEAD:
                with np.errstate(over="ignore"):
                    for (at, _), words in zip(self._runs, made[len(head)], strict=True):
                        out[at] = _md5_heads([w | f if f else w for w, f in zip(words, first, strict=True)])
            else:
                for at, tail in self._runs:
                    out[at] = [int(hashlib.md5(head + t.tobytes()).hexdigest()[:8], 16) for t in tail]
            for at, tail in self._long:
                out[at] = int(hashlib.md5(head + tail).hexdigest()[:8], 16)
            yield rep, out
