"""From raw corpora to the unified table, and from free text to an unlabelled pool."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from textgrade.functions.text import TARGET_WORDS, evenly_spaced, text_key, window_text
from textgrade.operators.quality import LANGUAGES, MAX_TOKENS, MIN_TOKENS, drop_repeats, keep_in_band
from textgrade.operators.ranks import POLARITY, SPACING, harmonize
from textgrade.operators.splits import SEED, VAL_FRACTION, assign_splits
from textgrade.schema import canonical, coerce, with_defaults
from textgrade.sources.corpora import fetch_texts
from textgrade.sources.settled import settle

POOL_MIN_TOKENS = 50
POOL_MAX_TOKENS = 320
CHUNKS_PER_DOCUMENT = 5


def union_corpora(corpora: list[DataFrame]) -> DataFrame:
    """Several corpora as one canonical table."""
    return reduce(DataFrame.unionByName, [coerce(c) for c in corpora])


def filter_settled(
    df: DataFrame, min_tokens: int = MIN_TOKENS, max_tokens: int = MAX_TOKENS, languages: tuple[str, ...] = LANGUAGES
) -> DataFrame:
    """``filter_corpus`` of rows that cost much to make: those in the band are written once, with a key of their text."""
    banded = keep_in_band(df, min_tokens, max_tokens, languages).withColumn("_text_key", text_key("text"))
    return drop_repeats(settle(banded), key=F.col("_text_key")).drop("_text_key")


def prepare_corpus(
    corpora: list[DataFrame],
    min_tokens: int = MIN_TOKENS,
    max_tokens: int = MAX_TOKENS,
    languages: tuple[str, ...] = LANGUAGES,
    polarity: dict[str, bool] | bool = POLARITY,
    holdout_corpora: list[str] | None = None,
    holdout_formats: list[str] | None = None,
    val_fraction: float = VAL_FRACTION,
    seed: int = SEED,
    spacing: int = SPACING,
) -> DataFrame:
    """Union, quality filter, difficulty axis, splits: the unified table.

    The rows in the band are settled once with a key of their text. Removal of repeats, ranking and the
    split draw read them again, all without the texts.
    """
    clean = filter_settled(union_corpora(corpora), min_tokens, max_tokens, languages)
    ranked = harmonize(clean, polarity=polarity, spacing=spacing)
    return canonical(assign_splits(ranked, holdout_corpora, holdout_formats, val_fraction, seed))


def chunk_documents(
    docs: DataFrame,
    min_tokens: int = POOL_MIN_TOKENS,
    max_tokens: int = POOL_MAX_TOKENS,
    max_chunks_per_doc: int = CHUNKS_PER_DOCUMENT,
) -> DataFrame:
    """Documents ``(source, doc_index, text, domain)`` as canonical unlabelled excerpts.

    Long documents give a few evenly spaced excerpts, numbered anew.
    """
    windows = docs.select(
        "source",
        "doc_index",
        "domain",
        window_text("text", TARGET_WORDS, max_tokens, min_tokens).alias("w"),
    )
    kept = windows.select("source", "doc_index", "domain", evenly_spaced(F.col("w"), max_chunks_per_doc).alias("w"))
    chunks = kept.select("source", "doc_index", "domain", F.posexplode_outer("w").alias("chunk", "text"))
    return with_defaults(
        chunks.where("text is not null").select(
            F.concat_ws(":", "source", "doc_index", "chunk").alias("id"),
            "text",
            F.col("source").alias("corpus"),
            F.lit("unlabeled").alias("native_scale"),
            "domain",
            F.lit("unlabeled").alias("split"),
        )
    )


def build_external_pool(
    docs: DataFrame,
    per_source_docs: int | None,
    order_col: str,
    min_tokens: int = POOL_MIN_TOKENS,
    max_tokens: int = POOL_MAX_TOKENS,
    max_chunks_per_doc: int = CHUNKS_PER_DOCUMENT,
    spacing: int = SPACING,
) -> DataFrame:
    """Free text ``(source, domain, text, <order_col>)`` as a filtered pool of excerpts.

    Of every source the first ``per_source_docs`` documents (all, if None) are taken.
    """
    fetched = fetch_texts(docs, per_source_docs, order_col, spacing=spacing)
    chunks = chunk_documents(fetched, min_tokens, max_tokens, max_chunks_per_doc)
    return filter_settled(chunks, min_tokens, max_tokens)
