"""The byte-level tokenizer, loaded once in each Python worker from the public vocabulary file."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np

# Fixed value: how the byte-level vocabulary cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White space runs from this length on are cut out before the pattern is applied, whose lookahead keeps a state for
#: every character of a run. The class is Unicode white space, without the information separators.
LONG_RUN = 1 << 16
_LONG_SPACE = re.compile(rf"[^\S\x1c-\x1f]{{{LONG_RUN},}}")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_letter() -> dict[str, int]:
    """Printable bytes stand for themselves in the file, the others for the letters from 256 on, in order."""
    shown = {b for low, high in (("!", "~"), ("¡", "¬"), ("®", "ÿ")) for b in range(ord(low), ord(high) + 1)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def encoder(path: str):
    """An encoder of the vocabulary at ``path``, one that takes a text as a single piece, and the bytes of each id.

    The file's ids are in order of merging, so they serve as merge ranks. The fast encoder gives the same ids as the
    library that the file is made for; strings of special tokens are ordinary text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    byte_of = _byte_of_letter()
    special = {t["content"] for t in content.get("added_tokens", [])}
    ranks = {
        bytes(byte_of[x] for x in token): rank for token, rank in content["model"]["vocab"].items() if token not in special
    }
    widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    words, piece = (
        tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for name, pattern in (("byte_bpe", PATTERN), ("byte_bpe_piece", r"(?s:.)+"))
    )
    return words, piece, widths


def ids_of(text: str, path: str) -> np.ndarray:
    """The ids of a whole text. A run of white space is one piece, without its last character if more text follows."""
    words, piece, _ = encoder(path)
    if len(text) < LONG_RUN:
        return words.encode_to_numpy(text)
    parts, at = [], 0
    for run in _LONG_SPACE.finditer(text):
        stop = run.end() - (run.end() < len(text))
        parts += [words.encode_to_numpy(text[at : run.start()]), piece.encode_to_numpy(text[run.start() : stop])]
        at = stop
    return np.concatenate([*parts, words.encode_to_numpy(text[at:])])
