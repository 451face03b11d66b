"""Token counts of the sections of a document from one encoding of the whole.

A document is encoded once; its tokens follow each other without gaps, so their byte spans are the running sums of
their lengths. Sections, given by character offsets (or the lines of the text), are mapped to bytes and joined to the
tokens by binary search on the sorted spans, which also serves overlapping and nested sections.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textgrade.llm.tokenizers_ import default_path, encoder, ids_of

RULES = ("start", "share")


def token_ends(text: str, path: str) -> np.ndarray:
    """Where each token of the text ends, in bytes of its UTF-8."""
    return np.cumsum(encoder(path)[-1][ids_of(text, path)])


def attribute(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, stops: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by ``rule``, and how many of those that touch it also reach beyond it.

    ``start`` gives a token to the sections that hold its first character (a token that begins inside a character
    begins with it), ``share`` gives every section its part of the token's bytes. Offsets are in characters.
    """
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    to_byte = np.append(heads, len(data))
    low, high = (to_byte[np.clip(side, 0, len(heads))] for side in (starts, stops))
    high = np.maximum(high, low)
    begins = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    within = np.searchsorted(begins, high) - np.searchsorted(begins, low)
    over_low = _inside(begins, ends, low)
    over_high = _inside(begins, ends, high)
    crossing = np.where(high > low, (over_low >= 0).astype(np.int64) + (over_high >= 0), 0)
    crossing -= (over_low >= 0) & (over_low == over_high) & (high > low)
    if rule == "start":
        return within.astype(np.float64), crossing
    before = np.concatenate(([0], np.arange(1, len(ends) + 1)))
    edges = np.concatenate(([0], ends))
    part = np.interp(high, edges, before) - np.interp(low, edges, before)
    return part, crossing


def _inside(begins: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The token that has ``at`` strictly inside, or -1."""
    k = np.searchsorted(begins, at, side="left") - 1
    safe = np.clip(k, 0, None)
    return np.where((k >= 0) & (len(ends) > 0) & (at < (ends[safe] if len(ends) else 0)), k, -1)


def _counts(path: str, rule: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[np.ndarray] = []
            parts: list[tuple] = []
            spans = batch.column("sections") if given else None
            for k, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                if given:
                    wanted = [s for s in spans[k].as_py() or [] if s and s["start"] is not None and s["stop"] is not None]
                    starts, stops = (np.array([s[c] for s in wanted], dtype=np.int64) for c in ("start", "stop"))
                else:
                    breaks = np.flatnonzero(data[(data & 0xC0) != 0x80] == 10) + 1
                    starts = np.concatenate(([0], breaks))
                    stops = np.append(breaks, len(text))
                count, crossing = attribute(data, token_ends(text, path), starts, stops, rule)
                rows.append(np.full(len(starts), k))
                parts.append((np.arange(len(starts)), starts, stops, count, crossing))
            if not rows:
                continue
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            kinds = [np.int32, np.int64, np.int64, np.float64, np.int64]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(np.concatenate(rows).astype(np.int64))),
                    *[pa.array(c.astype(t)) for c, t in zip(columns, kinds, strict=True)],
                ],
                names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"],
            )

    return run


def section_tokens(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
    rule: str = "start",
    tokenizer: str | None = None,
) -> DataFrame:
    """Per section: ``doc_id, section, start, stop, n_tokens, n_crossing``.

    Sections are structs of ``start`` and ``stop`` (characters, exclusive) in an array column; without one they are
    the lines, each with its line feed. Under ``start`` the counts of sections that partition a text add up to its
    tokens; under ``share`` as well, in fractions. A null text is empty: it has one empty line. A null or empty array
    has no sections, a null section or bound is skipped, bounds beyond the text are cut. Repeated rows are each
    counted; an empty table gives an empty result; other columns are ignored. Nothing is shuffled.
    """
    if rule not in RULES:
        raise ValueError(f"the rule is one of {RULES}")
    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if sections_col is not None:
        columns.append(F.col(sections_col).alias("sections"))
    source = docs.select(*columns)
    kind = source.schema["doc_id"].dataType.simpleString()
    counted = source.mapInArrow(
        _counts(tokenizer or default_path(), rule, sections_col is not None),
        f"doc_id {kind}, section int, start long, stop long, n_tokens double, n_crossing long",
    )
    return counted.withColumn("n_tokens", F.col("n_tokens").cast("long")) if rule == "start" else counted
