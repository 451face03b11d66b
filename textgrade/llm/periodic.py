"""Periodic runs of words: stretches that repeat with some period at least four times.

Periods are handled by octaves ``[P, 2P)``. Words get a boundary every ``P`` words. A run of a period in the octave has
at least three periods of words that equal the word one period on, so it holds boundaries whose next ``P`` words come
again one period later. Hashes of blocks of ``P`` words, found by doubling, tell which boundaries have such a period.
There the Z-functions of the words behind the boundary and, backwards, of those before it give for each period how far
words agree with the words one period on: a fragment of a run, exact up to its reach of ``P`` words before and ``2P``
behind. Fragments of neighbouring boundaries touch, and are stitched by document and period.

A document is cut into tiles that overlap by the reach of the octaves they are for. One tile is solved where it is cut.
Several, of a long document, are rows that Spark deals out. Fragments meet in a shuffle by document and period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from textgrade.llm.hashing import mix
from textgrade.sources.settled import settle

#: A run has at least so many periods and so many words.
REPEATS, LEAST = 4, 6
#: Words in the body of a tile, and the octaves it is for; each higher octave has tiles of its own, eight times its period.
TILE, LOW_OCTAVES = 1 << 13, 11
#: Words solved at a time when short documents are put in a row.
BATCH = 1 << 17


def z_function(s: list) -> list[int]:
    """For each place how many items from there on agree with the beginning."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _block_hashes(ids: np.ndarray, octaves: int) -> Iterator[np.ndarray]:
    """For P = 1, 2, 4, .. the hashes of the ``P`` items from each place on; shorter at the end."""
    with np.errstate(over="ignore"):
        names = mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        for octave in range(octaves):
            yield names
            width = 1 << octave
            if len(names) <= width:
                return
            names = mix(names[:-width] * np.uint64(0x9E3779B97F4A7C15) + names[width:])


def fragments(ids: np.ndarray, low: int, high: int, octaves: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
    """``(period, start, end)`` for boundaries in ``[low, high)``: words start .. end-1 equal those a period on.

    Fragments of a period that touch are one. ``low`` is a multiple of the periods at which octaves begin, or 0.
    """
    n = len(ids)
    for octave, names in enumerate(_block_hashes(ids, octaves[1])):
        if octave < octaves[0]:
            continue
        step = 1 << octave
        rows = names[: len(names) // step * step].reshape(-1, step)
        # a boundary's block against the blocks that begin one period of the octave later
        hits = np.flatnonzero((rows[1:] == rows[:-1, :1]).any(axis=1))
        hits = hits[(hits * step >= low) & (hits * step < high)]
        # the last row may be cut, so the boundaries before it are all tried
        tail = range(max(low // step, len(rows) - 1), -(-min(high, n) // step))
        open_: dict[int, list[int]] = {}
        for c in [step * int(h) for h in hits] + [step * t for t in tail if t not in hits]:
            ahead = ids[c : c + 4 * step].tolist()
            right = z_function(ahead)
            periods = [q for q in range(step, min(2 * step, len(ahead))) if right[q] >= step]
            if not periods:
                continue
            before = ids[max(c - step, 0) : c][::-1].tolist()
            around = ids[max(c - step, 0) : c + 2 * step][::-1].tolist()
            back = z_function([*before, -1 << 62, *around])
            for q in periods:
                at = len(before) + 1 + len(around) - len(before) - q
                reach = back[at] if at < len(back) else 0
                start, end = c - reach, c + min(right[q], 2 * step)
                last = open_.get(q)
                if last is not None and start <= last[1]:
                    last[1] = max(last[1], end)
                    continue
                if last is not None:
                    yield q, last[0], last[1]
                open_[q] = [start, end]
        for q, (start, end) in open_.items():
            yield q, start, end


def tiles_of(n: int) -> list[tuple[int, int, int, int, int, int]]:
    """``(first octave, end of octaves, window start, window end, low, high)`` of a document of ``n`` words.

    The window reaches the octaves' largest ``P`` before the body ``[low, high)`` and four of it behind.
    """
    most = n // REPEATS
    if most == 0:
        return []
    octaves = most.bit_length()
    if n <= TILE:
        return [(0, octaves, 0, n, 0, n)]
    groups = [(0, min(LOW_OCTAVES, octaves))] + [(o, o + 1) for o in range(LOW_OCTAVES, octaves)]
    out = []
    for first, end in groups:
        widest = 1 << (end - 1)
        body = max(TILE, 8 * widest)
        for low in range(0, n, body):
            out.append((first, end, max(low - widest, 0), min(low + body + 4 * widest, n), low, min(low + body, n)))
    return out


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth checksum makes the document's end repeat itself; the query's way to have runs of all kinds."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


_CUT = (
    "row long, doc_id long, n long, flat string, body binary, period int, start long, stop long, "
    "first int, last int, at long, low long, high long, ids binary"
)
_ARROW = pa.schema(
    [
        ("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("flat", pa.string()), ("body", pa.binary()),
        ("period", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()),
        ("first", pa.int32()), ("last", pa.int32()), ("at", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("ids", pa.binary()),
    ]
)


def _is_run(period: int, start: int, stop: int) -> bool:
    return stop - start + period >= max(LEAST, REPEATS * period)


def _solve_short(short: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int, int]]:
    """``(row, period, start, stop)`` of documents of one tile, put in a row with separators that equal nothing."""
    by_octaves: dict[int, list[tuple[int, np.ndarray]]] = {}
    for row, ids in short:
        by_octaves.setdefault((len(ids) // REPEATS).bit_length(), []).append((row, ids))
    for octaves, some in by_octaves.items():
        if octaves == 0:
            continue
        parts, starts, at = [], [], 0
        for k, (_, ids) in enumerate(some):
            parts += [ids, np.array([-1 - k])]
            starts.append(at)
            at += len(ids) + 1
        line = np.concatenate(parts)
        for q, start, stop in fragments(line, 0, len(line), (0, octaves)):
            if _is_run(q, start, stop):
                k = int(np.searchsorted(starts, start, side="right")) - 1
                yield some[k][0], q, start - starts[k], stop - starts[k]


def _cut(plant: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids_of, texts = batch.column(0), batch.column(1)
            low = 0
            while low < len(texts):
                out: list[dict] = []
                short: list[tuple[int, np.ndarray]] = []
                bodies: dict[int, list[bytes]] = {}
                size = 0
                while low < len(texts) and size < BATCH:
                    doc_id = ids_of[low].as_py()
                    words = (texts[low].as_py() or b"").split()  # of bytes: at exactly the six white space characters
                    if plant:
                        words = planted(words, doc_id)
                    known: dict[bytes, int] = {}
                    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
                    body = b" ".join(words)
                    doc = {"row": row, "doc_id": doc_id, "n": len(words), "flat": _sha(body), "body": None}
                    out.append(doc)
                    bodies[row] = body
                    tiles = tiles_of(len(words))
                    if len(tiles) == 1:
                        short.append((row, ids))
                    elif tiles:
                        doc["body"] = body
                        small = ids.astype("<i4")
                        for first, last, at, end, a, b in tiles:
                            out.append(
                                {"row": row, "first": first, "last": last, "at": at, "low": a - at, "high": b - at, "ids": small[at:end].tobytes()}
                            )
                    size += len(words) + 1
                    row += 1
                    low += 1
                found = {}
                for of, q, start, stop in _solve_short(short):
                    found.setdefault(of, []).append((q, start, stop))
                for doc in [d for d in out if d["row"] in found and "n" in d]:
                    doc["body"] = bodies[doc["row"]]
                    out += [{"row": doc["row"], "period": q, "start": s, "stop": e} for q, s, e in found[doc["row"]]]
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return run


_FRAGMENT = pa.schema([("row", pa.int64()), ("period", pa.int32()), ("start", pa.int64()), ("stop", pa.int64())])


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for tile in batch.to_pylist():
            ids = np.frombuffer(tile["ids"], dtype="<i4").astype(np.int64)
            got = fragments(ids, tile["low"], tile["high"], (tile["first"], tile["last"]))
            rows = [{"row": tile["row"], "period": q, "start": s + tile["at"], "stop": e + tile["at"]} for q, s, e in got]
            yield pa.RecordBatch.from_pylist(rows, schema=_FRAGMENT)


def stitched(pieces: DataFrame) -> DataFrame:
    """Runs ``(row, start, length, period)`` of fragments ``(row, period, start, stop)``.

    Touching fragments of a document and period are one stretch. Where stretches of several periods are the same words,
    the longer periods are multiples of the smallest, the period of the run.
    """
    by = Window.partitionBy("row", "period").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before >= F.col("start"), 0).otherwise(1)
    numbered = pieces.withColumn("new", new).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("row", "period", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    length = F.col("stop") - F.col("start") + F.col("period")
    runs = whole.select("row", "start", length.alias("length"), "period").where(
        F.col("length") >= F.greatest(F.lit(LEAST), REPEATS * F.col("period"))
    )
    return runs.groupBy("row", "start", "length").agg(F.min("period").cast("long").alias("period"))


_OUT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>, collapsed string"
)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
            ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
            ("runs", pa.list_(run)), ("collapsed", pa.string()),
        ]
    )
    for batch in batches:
        out = []
        for doc in batch.to_pylist():
            runs = sorted((r["start"], r["period"], r["length"]) for r in doc["runs"] or [])
            row = {"doc_id": doc["doc_id"], "n_runs": len(runs), "runs_sha256": _sha(b""), "collapsed_sha256": doc["flat"]}
            if runs:
                words = doc["body"].split(b" ")
                drop = np.zeros(len(words) + 1, dtype=np.int64)
                for start, period, length in runs:
                    drop[start + period] += 1
                    drop[start + length] -= 1
                gone = np.cumsum(drop[:-1]) > 0
                kept = b" ".join(w for w, out_ in zip(words, gone.tolist(), strict=True) if not out_)
                start, period, length = max(runs, key=lambda r: (Fraction(r[2], r[1]), -r[0], -r[1]))
                row |= {"start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period}
                row |= {"runs_sha256": _sha("".join(f"{s},{n},{p}\n" for s, p, n in runs).encode())}
                row |= {"collapsed_sha256": _sha(kept), "collapsed": kept.decode("utf-8", "replace")}
                row |= {"runs": [{"start": s, "length": n, "period": p} for s, p, n in runs]}
            out.append(row)
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """A row for each row: its runs, the one with the most repeats, and its text with each run cut to one period.

    ``runs`` are ``(start, length, period)`` in words, by start, then period; ``collapsed`` is the text of the words that
    no run contains behind its first period, null where there is no run. ``runs_sha256`` and ``collapsed_sha256`` are
    digests of either and never null. ``plant`` first makes the ends of some documents repeat, as the query does.

    Null and empty texts have no words and no runs; ids may be null or repeated, as rows are told apart by their place;
    long texts are cut into tiles; an empty table has no rows; other columns are ignored, whatever their names.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    cut = settle(docs.mapInArrow(_cut(plant), _CUT))
    tiles = cut.where("ids is not null").select("row", "first", "last", "at", "low", "high", "ids")
    dealt = tiles.repartition("row", "first", "at")
    far = dealt.mapInArrow(_solve_tiles, "row long, period int, start long, stop long")
    near = cut.where("period is not null").select("row", "period", "start", "stop")
    runs = stitched(near.unionByName(far)).groupBy(F.col("row").alias("of"))
    listed = runs.agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    documents = cut.where("n is not null").select("row", "doc_id", "flat", "body")
    # only documents with a fragment or several tiles carry their words
    met = documents.where("body is not null").join(listed, F.col("row") == F.col("of"), "left")
    told = met.select("doc_id", "flat", "body", "runs").mapInArrow(_summarise, _OUT)
    kinds = dict(c.split() for c in _OUT.split(", "))
    own = {
        "doc_id": F.col("doc_id"),
        "n_runs": F.lit(0).cast("long"),
        "runs_sha256": F.sha2(F.lit("").cast("binary"), 256),
        "collapsed_sha256": F.col("flat"),
    }
    plain = documents.where("body is null").select(*[own.get(c, F.lit(None).cast(t)).alias(c) for c, t in kinds.items()])
    return told.unionByName(plain).withColumnRenamed("doc_id", id_col)
