"""I-Match fingerprints: hashes of the distinct terms of a text that lie in a band of inverse document frequency.

Document frequencies of all terms are counted over all documents. Terms in the band form the lexicon. A text's distinct
lexicon terms are sorted and hashed once for each of several randomised subsets of the lexicon. Subsets come in levels
that hold a quarter, a sixteenth, .. of it, so that short and long texts alike have subsets in which a small edit
changes nothing. A subset's hash stays the same if and only if no term of the subset came or went, with the chance
``(1 - share) ** changed``; the likeness of two fingerprints is the share of common terms that makes the
observed agreement most probable.

The band is bounded below relative to the number of documents, and where it would still hold more than
``LEXICON`` terms its lower edge is raised: the lexicon, the only thing that is broadcast, has a size bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from textgrade.llm.hashing import mix, text_bytes, words
from textgrade.sources.settled import settle

#: Terms are in the band if at most one in RARE_FROM and at least one in RARE_TO documents have them.
RARE_FROM, RARE_TO = 20, 4000
#: Terms in the lexicon at most, 8 bytes each.
LEXICON = 1 << 21
#: Shares of the lexicon in the subsets of a level, and subsets in a level.
SHARES = tuple(1 / 4**k for k in range(1, 7))
SUBSETS = 12
#: Documents worked on at a time.
BLOCK = 512
_EDGES = np.arange(65) / 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def lexicon_of(
    texts: DataFrame, rare_from: int = RARE_FROM, rare_to: int = RARE_TO, most: int = LEXICON
) -> np.ndarray:
    """Sorted hashes of the terms in the band, from the one column ``text`` of all documents."""
    n = texts.count()
    counts = settle(
        texts.mapInArrow(_term_counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).where(
            (F.col("df") >= n / rare_to) & (F.col("df") <= max(1, n / rare_from))
        )
    )
    if counts.count() > most:
        # a row for each frequency; from the highest down as long as the terms fit
        steps = counts.groupBy("df").agg(F.count(F.lit(1)).alias("terms"))
        upto = F.sum("terms").over(Window.orderBy(F.col("df").desc()))
        least = steps.select("df", upto.alias("upto")).where(F.col("upto") <= most).agg(F.min("df")).first()[0]
        counts = counts.where(F.col("df") >= least) if least is not None else counts.limit(0)
    return np.sort(counts.select("term").toArrow().column("term").to_numpy().astype(np.int64).view(np.uint64))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            first, hashes = words(*text_bytes(batch.column(0).slice(low, BLOCK)))
            doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
            order = np.lexsort((doc, hashes))
            hashes, doc = hashes[order], doc[order]
            if len(hashes) == 0:
                continue
            new_term = np.concatenate(([True], hashes[1:] != hashes[:-1]))
            new_pair = new_term | np.concatenate(([True], doc[1:] != doc[:-1]))
            at = np.flatnonzero(new_term)
            df = np.add.reduceat(new_pair.astype(np.int64), at)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(df)], names=["term", "df"])


@dataclass
class Lexicon:
    """The terms and, for each level of subsets, the subset that a term is in (or one beyond the last, for none)."""

    terms: np.ndarray

    def __post_init__(self) -> None:
        with np.errstate(over="ignore"):
            self.subset = [
                # several hash functions where a level has fewer disjoint subsets than asked for
                [self._dealt(level, turn) for turn in range(-(-SUBSETS // round(1 / share)))]
                for level, share in enumerate(SHARES)
            ]
            self.names = mix(self.terms * _GOLD + np.uint64(1))

    def _dealt(self, level: int, turn: int) -> np.ndarray:
        seed = np.uint64(1000 * (level + 1) + turn)
        parts = round(1 / SHARES[level])
        at = (mix(self.terms ^ mix(np.array([seed], dtype=np.uint64))) % np.uint64(parts)).astype(np.int64)
        wanted = min(parts, SUBSETS - turn * parts)
        return np.where(at < wanted, at + turn * parts, SUBSETS)

    def signatures(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of its lexicon terms, and a 16-bit hash for each subset."""
        n = len(texts)
        sizes = np.zeros(n, dtype=np.int64)
        out = np.zeros((n, len(SHARES), SUBSETS), dtype=np.uint16)
        first, hashes = words(*text_bytes(pa.array(texts, pa.large_string())))
        if len(self.terms) == 0 or len(hashes) == 0:
            return sizes, out.reshape(n, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        known = self.terms[at] == hashes
        doc = np.repeat(np.arange(n), np.diff(first))[known]
        # distinct terms of every text, sorted
        pairs = np.unique((doc << 32) | at[known])
        doc, term = pairs >> 32, pairs & 0xFFFFFFFF
        sizes[:] = np.bincount(doc, minlength=n)
        for level, dealt in enumerate(self.subset):
            for subset in dealt:
                cell = doc * (SUBSETS + 1) + subset[term]
                order = np.argsort(cell, kind="stable")
                cell, name = cell[order], self.names[term[order]]
                begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else cell
                if len(begin) == 0:
                    continue
                with np.errstate(over="ignore"):
                    place = np.arange(len(cell)) - np.repeat(begin, np.diff(np.append(begin, len(cell))))
                    summed = np.add.reduceat(mix(name + place.astype(np.uint64) * _GOLD), begin)
                    value = (mix(summed) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)  # 0 is for no term
                row, column = cell[begin] // (SUBSETS + 1), cell[begin] % (SUBSETS + 1)
                real = column < SUBSETS
                out[row[real], level, column[real]] = value[real]
        return sizes, out.reshape(n, -1)

    def fingerprints(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Sizes, signatures and fingerprints. A text without lexicon terms has the hash of its words instead."""
        sizes, signatures = self.signatures(texts)
        shown = signatures.astype(">u2")
        names = [
            f"{n:08x}{row.tobytes().hex()}" if n else "00000000" + hashlib.sha256(" ".join(_plain(text)).encode()).hexdigest()
            for n, row, text in zip(sizes.tolist(), shown, texts, strict=True)
        ]
        return sizes, signatures, names


def _plain(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().lower().split()]


def likeness(
    size: np.ndarray, signature: np.ndarray, name: list[str], size2: np.ndarray, signature2: np.ndarray, name2: list[str]
) -> np.ndarray:
    """Row by row the share of common terms that the fingerprints speak for: 1 for equal ones, 0 without a common term."""
    n = len(name)
    both = (size + size2).astype(float)
    agree = (signature == signature2).reshape(n, len(SHARES), SUBSETS).sum(axis=2)
    # terms that came or went, as a share of the terms of both: from |difference| to all
    apart = np.abs(size - size2)[:, None] + _EDGES[None, :] * (both - np.abs(size - size2))[:, None]
    score = np.zeros_like(apart)
    for level, share in enumerate(SHARES):
        stays = np.log1p(-share) * apart
        moves = np.log(np.maximum(-np.expm1(stays), 1e-300))
        score += agree[:, level, None] * stays + (SUBSETS - agree[:, level, None]) * moves
    changed = apart[np.arange(n), score.argmax(axis=1)]
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.where((size > 0) & (size2 > 0), (both - changed) / (both + changed), 0.0)
    # a common term shows as an agreeing hash of a subset that is not empty
    out[~((signature == signature2) & (signature > 0)).any(axis=1)] = 0.0
    out[np.array([a == b for a, b in zip(name, name2, strict=True)], dtype=bool)] = 1.0
    return out


def _cuts(ids: DataFrame, pieces: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int] | None]:
    """Keys of rows at which pieces begin, and the first key: ``pieces`` keys or fewer, drawn by their own hash."""
    n = ids.count()
    if n == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), None
    first = ids.orderBy("key", "digest").first()
    every = max(1, n // (16 * pieces))
    drawn = ids.where(F.pmod(F.xxhash64("key", "digest"), F.lit(every)) == 0).distinct().orderBy("key", "digest").toArrow()
    keys, digests = (drawn.column(c).to_numpy() for c in ("key", "digest"))
    step = max(1, len(keys) // pieces)
    keys, digests = keys[step - 1 :: step], digests[step - 1 :: step]
    real = (keys != first["key"]) | (digests != first["digest"])
    return keys[real], digests[real], (first["key"], first["digest"])


def _pieces(shared):
    """Gives every row its piece; the row that begins a piece also goes, as a guest, to the end of the one before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, digests, first = shared.value
        for batch in batches:
            key, digest = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            piece = np.searchsorted(keys, key, side="left")
            # among cuts of the same key the digest decides
            for k in np.flatnonzero(np.searchsorted(keys, key, side="right") > piece).tolist():
                while piece[k] < len(keys) and keys[piece[k]] == key[k] and digests[piece[k]] <= digest[k]:
                    piece[k] += 1
            heads = [
                k
                for k in np.flatnonzero(piece > 0).tolist()
                if keys[piece[k] - 1] == key[k] and digests[piece[k] - 1] == digest[k]
            ]
            begins = np.flatnonzero((key == first[0]) & (digest == first[1])).tolist()
            rows = np.array([*range(len(key)), *heads, *begins], dtype=np.int64)
            to = np.concatenate([piece, piece[heads] - 1, np.full(len(begins), len(keys))]).astype(np.int32)
            guest = np.concatenate([np.zeros(len(key)), np.ones(len(heads)), np.full(len(begins), 2)]).astype(np.int32)
            moved = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*moved.columns, pa.array(to), pa.array(guest)], names=[*batch.schema.names, "piece", "guest"])

    return run


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def _compare(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(shared.value)
        held = None
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = batch.slice(low, BLOCK)
                rows = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True))
                if held is not None:
                    rows = [held, *rows]
                held = rows[-1]
                yield _results(lexicon, rows)

    return run


def _results(lexicon: Lexicon, rows: list) -> pa.RecordBatch:
    """Results of all rows but the last, each next to its successor; guests close a piece and have none."""
    texts = [r[1] or "" for r in rows]
    edited = []
    for k in range(len(rows) - 1):
        n = len(texts[k])
        edited.append(texts[k][: n - n // 4] + texts[k + 1][: n // 4])
    whole = lexicon.fingerprints(texts)
    changed = lexicon.fingerprints(edited)
    own = tuple(x[:-1] for x in whole)
    near_edited = likeness(*own, *changed)
    near_next = likeness(*own, *(x[1:] for x in whole))
    keep = [k for k in range(len(rows) - 1) if rows[k][3] == 0]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array([rows[k][0] for k in keep], pa.int64()),
            "n_chars": pa.array([len(texts[k]) for k in keep], pa.int64()),
            "edited_sha256": pa.array([hashlib.sha256(edited[k].encode()).hexdigest() for k in keep], pa.string()),
            "fingerprint": pa.array([own[2][k] for k in keep], pa.string()),
            "edited_fingerprint": pa.array([changed[2][k] for k in keep], pa.string()),
            "near_edited": pa.array(near_edited[keep], pa.float64()),
            "near_next": pa.array(near_next[keep], pa.float64()),
        }
    )


def fingerprint_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rare_from: int = RARE_FROM,
    rare_to: int = RARE_TO,
) -> DataFrame:
    """A row for each row: its fingerprint, that of its edited text, and how alike it is to that and to the next row.

    The next row is the one with the next greater integer id (nulls first, equal ids by a hash of the text; after the last comes
    the first). The edited text has its last quarter replaced by as many characters from the next one's beginning. Rows are
    dealt into consecutive pieces, so that a row and the next one meet in a task; each piece ends with the first row of the
    next.

    Null texts count as empty. A text without a term in the band is fingerprinted by all its words, and is alike only to
    texts of the same words. Equal texts have equal fingerprints. A single row is its own next; an empty table has no rows; other
    columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    texts = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), texts.alias("text"))
    lexicon = spark.sparkContext.broadcast(lexicon_of(docs.select("text"), rare_from, rare_to))
    keyed = docs.select(
        "id", "text", F.coalesce("id", F.lit(-(1 << 63)).cast("long")).alias("key"), F.xxhash64("text").alias("digest")
    )
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # several short pieces a partition, as their hashes do not deal them out evenly
    cuts = _cuts(settle(keyed.select("key", "digest")), 4 * pieces)
    if cuts[2] is None:
        return spark.createDataFrame([], _OUT).withColumnRenamed("doc_id", id_col)
    shared = spark.sparkContext.broadcast(cuts)
    placed = keyed.mapInArrow(_pieces(shared), "id long, text string, key long, digest long, piece int, guest int")
    dealt = placed.repartition(pieces, "piece").sortWithinPartitions("piece", "guest", "key", "digest")
    out = dealt.select("id", "text", "piece", "guest").mapInArrow(_compare(lexicon), _OUT)
    return out.withColumnRenamed("doc_id", id_col)
