"""Text functions as column expressions; only the paragraph packer runs in Python."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, functions as F

# The characters counted as white space (Unicode separators and control blanks),
# as the inside of a regular-expression class.
BLANK = r"\s\x1c-\x1f\x85\p{Z}"
BLANKS = f"[{BLANK}]+"
BLANK_CHARACTERS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)

# Weights of the readability proxy.
WORDS_PER_SENTENCE_WEIGHT = 0.39
CHARS_PER_WORD_WEIGHT = 5.8

# Excerpt sizes in words.
TARGET_WORDS = 180
MAX_WORDS = 320
MIN_WORDS = 50

# Texts of a batch that a task has as Python strings at a time.
SLICE = 256


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Trim all white space, not only the space character."""
    return F.btrim(_col(text), F.lit(BLANK_CHARACTERS))


def has_text(text: Column | str) -> Column:
    """Is there anything but white space?"""
    return _col(text).rlike(f"[^{BLANK}]")


def token_count(text: Column | str) -> Column:
    """Number of white-space separated tokens; null text has no count."""
    return F.regexp_count(_col(text), F.lit(f"[^{BLANK}]+")).cast("long")


def normal_form(text: Column | str) -> Column:
    """Trimmed, lower case, each run of white space as one space: the key of text identity."""
    return F.regexp_replace(F.lower(strip(text)), BLANKS, " ")


def text_key(text: Column | str) -> Column:
    """Short fixed-size stand-in for a text in grouping and join keys."""
    return F.sha2(_col(text), 256)


def difficulty_proxy(text: Column | str) -> Column:
    """Rough reading difficulty from sentence and word lengths; 0 where there are no words.

    Only ASCII letters and apostrophes make words; a text without end marks is one sentence.
    """
    text = _col(text)
    # the words are cut out once for both counts: used in every case, they are one common subexpression
    found = F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0))
    words, letters = F.array_size(found), F.length(F.array_join(found, ""))
    sentences = F.greatest(F.regexp_count(text, F.lit("[.!?]+")), F.lit(1))
    # without words there are no letters, and both terms are 0
    return F.lit(WORDS_PER_SENTENCE_WEIGHT) * (words / sentences) + F.lit(CHARS_PER_WORD_WEIGHT) * (
        letters / F.greatest(words, F.lit(1))
    )


def evenly_spaced(items: Column, keep: int) -> Column:
    """At most ``keep`` array items, first and last included, positions rounded half to even."""
    n = F.size(items)
    if keep == 1:
        picked = F.slice(items, 1, 1)
    else:
        places = F.array_distinct(
            F.transform(
                F.sequence(F.lit(0), F.lit(keep - 1)),
                lambda i: F.rint(i * ((n - 1) / F.lit(keep - 1))).cast("int"),
            )
        )
        picked = F.transform(places, lambda i: F.get(items, i))
    return F.when(n > keep, picked).otherwise(items)


def paragraphs(text: Column | str) -> Column:
    """Array of the parts between blank lines, without those of white space alone."""
    return F.filter(F.split(_col(text), f"\\n[{BLANK}]*\\n"), has_text)


def word_slice(text: Column | str, first: int, count: int) -> Column:
    """``count`` words from place ``first`` (from 0) on, joined by single spaces."""
    found = F.regexp_extract_all(_col(text), F.lit(f"([^{BLANK}]+)"), F.lit(1))
    return F.array_join(F.slice(found, first + 1, count), " ")


_PARAGRAPH_BREAK = re.compile(r"\n\s*\n")


def excerpts(text: str, target: int, most: int, least: int) -> list[str]:
    """Pack the paragraphs of one text into excerpts of about ``target`` words.

    A paragraph above ``most`` words is cut every ``target`` words and never shares an excerpt.
    A last excerpt below ``least`` words joins the one before it.
    """
    out: list[str] = []
    sizes: list[int] = []
    open_size = 0
    for block in _PARAGRAPH_BREAK.split(text):
        block = block.strip()
        words = block.split()
        size = len(words)
        if size == 0:
            continue
        if size > most:
            pieces = [words[at : at + target] for at in range(0, size, target)]
            out += [" ".join(piece) for piece in pieces]
            sizes += [len(piece) for piece in pieces]
            open_size = 0
        elif open_size and open_size + size <= target:
            out[-1] += " " + block
            open_size += size
            sizes[-1] = open_size
        else:
            out.append(block)
            sizes.append(size)
            open_size = size
    if len(out) > 1 and sizes[-1] < least:
        tail = out.pop()
        out[-1] += " " + tail
    return out


def window_text(
    text: Column | str,
    target_words: int = TARGET_WORDS,
    max_words: int = MAX_WORDS,
    min_words: int = MIN_WORDS,
) -> Column:
    """Array of excerpts per document. Follow with ``posexplode_outer`` to get one row each."""

    @F.arrow_udf("array<string>")
    def pack(texts: pa.Array) -> pa.Array:
        packed = [pa.array([], pa.list_(pa.string()))]
        # Python strings of a few texts at a time, whatever the size of the batch
        for low in range(0, len(texts), SLICE):
            few = texts.slice(low, SLICE).to_pylist()
            lists = [None if t is None else excerpts(t, target_words, max_words, min_words) for t in few]
            packed.append(pa.array(lists, pa.list_(pa.string())))
        return pa.concat_arrays(packed)

    return pack(_col(text))
