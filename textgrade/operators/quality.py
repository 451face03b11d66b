"""Quality filters, exact de-duplication and removal of texts known from a reference set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from textgrade.functions.text import has_text, normal_form, text_key
from textgrade.sources.settled import is_small, settle

# The default length band and language.
MIN_TOKENS = 3
MAX_TOKENS = 600
LANGUAGES = ("en",)


def keep_in_band(
    df: DataFrame,
    min_tokens: int = MIN_TOKENS,
    max_tokens: int = MAX_TOKENS,
    languages: tuple[str, ...] = LANGUAGES,
) -> DataFrame:
    """Rows with some text, a stored token count inside the closed band, and a wanted language.

    On a count that is a number the band reaches the Parquet scan.
    """
    count = F.col("length_tokens")
    if dict(df.dtypes)["length_tokens"] not in ("bigint", "int", "smallint", "tinyint"):
        count = count.try_cast("double")
    return df.where(
        F.col("language").isin(*languages)
        & count.between(min_tokens, max_tokens)
        & has_text("text")
    )


def _place(order_col: str) -> Column:
    """Sorting value of a row: rows without a value come last."""
    return F.struct(F.col(order_col).isNull().alias("none"), F.col(order_col).alias("value"))


def repeated_texts(df: DataFrame, order_col: str = "id", key: Column | None = None) -> DataFrame:
    """``(_corpus, _key, _first, _n)``: texts that occur more than once, the first place, and the rows at it."""
    key = text_key("text") if key is None else key
    narrow = df.select(F.col("corpus").alias("_corpus"), key.alias("_key"), _place(order_col).alias("place"))
    cells = narrow.groupBy("_corpus", "_key", "place").agg(F.count(F.lit(1)).alias("n"))
    texts = cells.groupBy("_corpus", "_key").agg(F.min(F.struct("place", "n")).alias("first"), F.sum("n").alias("rows"))
    return texts.where("rows > 1").select(
        "_corpus", "_key", F.col("first.place").alias("_first"), F.col("first.n").alias("_n")
    )


def drop_repeats(df: DataFrame, order_col: str = "id", key: Column | None = None) -> DataFrame:
    """One row per ``(corpus, text)``: the first by ``order_col``, rows without a value there last.

    Null corpora and null texts count as values. Of rows that agree in all three one stays, always the
    same. ``key`` is a stored ``text_key`` of the text, if the caller has one.

    Only keys of texts and order values are grouped, so a text that makes up a third of the table costs
    a narrow row per partition and place. What is repeated is written; while it is measured to be
    small it is sent to the rows, and texts stay where they are. ``df`` is read twice: settle it first
    if it is costly.
    """
    repeated = settle(repeated_texts(df, order_col, key))
    right = F.broadcast(repeated) if is_small(repeated) else repeated.hint("shuffle_hash")
    own = text_key("text") if key is None else key
    marked = df.withColumns({"_own": own, "_place": _place(order_col)})
    same = F.col("corpus").eqNullSafe(F.col("_corpus")) & F.col("_own").eqNullSafe(F.col("_key"))
    met = marked.join(right, same, "left").where("_n is null or _place <=> _first")
    single = met.where("_n is null or _n = 1").select(*df.columns)
    if repeated.where("_n > 1").isEmpty():
        return single
    # Rows that share the first place, too: the only ones grouped with their texts.
    hashed = F.xxhash64(*[name for name, kind in df.dtypes if "map<" not in kind])
    row = F.min_by(F.struct(*df.columns), hashed).alias("row")
    shared = met.where("_n > 1").groupBy("_corpus", "_key").agg(row).select("row.*")
    return single.unionByName(shared)


def filter_corpus(
    df: DataFrame,
    min_tokens: int = MIN_TOKENS,
    max_tokens: int = MAX_TOKENS,
    languages: tuple[str, ...] = LANGUAGES,
    order_col: str = "id",
) -> DataFrame:
    """Band and language filter, then exact duplicates within a corpus dropped."""
    return drop_repeats(keep_in_band(df, min_tokens, max_tokens, languages), order_col)


def dedup_against(df: DataFrame, reference: DataFrame, key: str = "text") -> DataFrame:
    """Rows whose normal form equals no reference text's. Null texts match nothing and stay."""
    known = reference.select(text_key(normal_form(key)).alias("_known")).distinct()
    marked = df.withColumn("_key", text_key(normal_form(key)))
    return marked.join(known, F.col("_key") == F.col("_known"), "left_anti").drop("_key")
