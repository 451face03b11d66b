"""Raw corpora into canonical rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textgrade.functions.numbers import as_number
from textgrade.functions.text import strip, window_text
from textgrade.operators.ranks import SPACING, running_totals
from textgrade.schema import with_defaults
from textgrade.sources.tables import number_rows, read_csv

# Column names a wide corpus file may use, and the names used here.
COLUMN_ALIASES = {"BT_easiness": "BT Easiness", "s.e.": "BT s.e.", "Categ": "Category"}

# Categories of the wide corpus.
CATEGORY_DOMAINS = {"lit": "literary", "info": "informational"}

# Reading levels as they end the file names, easiest first.
FILE_LEVELS = {"ele": 0, "int": 1, "adv": 2}

# Proficiency levels, easiest first.
PROFICIENCY_LEVELS = {"A1": 0, "A2": 1, "B1": 2, "B2": 3, "C1": 4, "C2": 5}

# Folder that holds the texts by level.
LEVEL_FOLDER = "Texts-SeparatedByReadingLevel"


def _lookup(values: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def repair_columns(df: DataFrame) -> DataFrame:
    """Rename known aliases where the proper column is absent."""
    have = set(df.columns)
    names = {a: c for a, c in COLUMN_ALIASES.items() if a in have and c not in have}
    return df.withColumnsRenamed(names)


def read_wide_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The wide labelled corpus as text columns with repaired names."""
    return repair_columns(read_csv(spark, path))


def wide_to_canonical(df: DataFrame, row_key: str, corpus: str = "clear") -> DataFrame:
    """Wide labelled rows as canonical ones; a row without a usable ID is named by ``row_key``."""
    number = as_number(F.col("ID"))
    name = F.when(number.isNotNull(), number.cast("long").cast("string")).otherwise(
        F.concat(F.lit("row"), F.col(row_key).cast("string"))
    )
    category = F.col("Category") if "Category" in df.columns else F.lit(None).cast("string")
    licence = F.col("License").cast("string") if "License" in df.columns else F.lit("unknown")
    return with_defaults(
        df.select(
            F.concat(F.lit(f"{corpus}:"), name).alias("id"),
            F.col("Excerpt").alias("text"),
            F.lit(corpus).alias("corpus"),
            F.col("BT Easiness").alias("native_label"),
            F.lit("clear_bt_easiness").alias("native_scale"),
            F.col("`BT s.e.`").alias("std_error"),
            F.coalesce(_lookup(CATEGORY_DOMAINS, F.lower(category)), F.lit("unknown")).alias("domain"),
            licence.alias("license"),
        )
    )


def load_wide_corpus(spark: SparkSession, path: str, row_key: str | None = None) -> DataFrame:
    """The wide labelled corpus as canonical rows, named by their place in the file unless ``row_key`` is given."""
    wide = read_wide_corpus(spark, path)
    return wide_to_canonical(wide, row_key) if row_key else wide_to_canonical(number_rows(wide, "_row"), "_row")


def decode_text(content: Column) -> Column:
    """UTF-8 without its byte order mark where the bytes are valid UTF-8, else Latin-1."""
    as_utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(as_utf8), F.regexp_replace(as_utf8, "^\\uFEFF", "")).otherwise(
        F.decode(content, "ISO-8859-1")
    )


def excerpt_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row per excerpt of column ``text``: ``chunk`` is its number, ``text`` the excerpt."""
    windows = df.select(*keep, window_text("text").alias("_w"))
    return windows.select(*keep, F.posexplode_outer("_w").alias("chunk", "text")).where(
        "text is not null"
    )


def load_level_tree(spark: SparkSession, root: str, corpus: str = "onestop") -> DataFrame:
    """Files ``<article>-<level>.txt`` under the level folder, as labelled excerpts.

    A file name that occurs in several folders of a level counts once, by the first path.
    """
    names = "*-{" + ",".join(FILE_LEVELS) + "}.txt"
    files = (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter=names)
        .load(root)
        .where(F.col("path").contains(f"/{LEVEL_FOLDER}/"))
    )
    if not files.select("path").limit(1).count():
        raise FileNotFoundError(f"no {LEVEL_FOLDER}/**/{names} under {root}")
    return level_tree_to_canonical(files, corpus)


def level_tree_to_canonical(files: DataFrame, corpus: str = "onestop") -> DataFrame:
    """Files ``(path, content)`` of a level tree as labelled excerpts; files outside of it are skipped."""
    shape = f"^(.*)-({'|'.join(FILE_LEVELS)})\\.txt$"
    named = files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "content").where(
        F.col("path").contains(f"/{LEVEL_FOLDER}/") & F.col("file").rlike(shape)
    )
    once = named.groupBy("file").agg(F.min_by("content", "path").alias("content"))
    texts = once.select(
        F.regexp_extract("file", shape, 1).alias("article"),
        F.regexp_extract("file", shape, 2).alias("level"),
        decode_text(F.col("content")).alias("text"),
    )
    return with_defaults(
        excerpt_rows(texts, "article", "level").select(
            F.concat_ws(":", F.lit(corpus), "article", "level", "chunk").alias("id"),
            "text",
            F.lit(corpus).alias("corpus"),
            _lookup(FILE_LEVELS, F.col("level")).alias("native_label"),
            F.lit("onestop_level").alias("native_scale"),
            F.lit("informational").alias("domain"),
            F.lit("CC-BY-SA-4.0").alias("license"),
        )
    )


def levelled_to_canonical(
    df: DataFrame, row_key: str, corpus: str = "cefr", text_col: str = "text", label_col: str = "label"
) -> DataFrame:
    """Texts labelled A1..C2 as excerpts with ordinal labels; other labels are skipped."""
    level = F.upper(strip(F.col(label_col).cast("string")))
    rows = df.select(F.col(row_key).alias("row"), level.alias("level"), F.col(text_col).alias("text"))
    known = rows.where(F.col("level").isin(*PROFICIENCY_LEVELS))
    return with_defaults(
        excerpt_rows(known, "row", "level").select(
            F.concat_ws(":", F.lit(corpus), "level", "row", "chunk").alias("id"),
            "text",
            F.lit(corpus).alias("corpus"),
            _lookup(PROFICIENCY_LEVELS, F.col("level")).alias("native_label"),
            F.lit("cefr_level").alias("native_scale"),
            F.lit("mixed").alias("domain"),
            F.lit("research").alias("license"),
        )
    )


def load_levelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """The two-column CSV ``text,label``; rows are numbered in file order."""
    raw = number_rows(read_csv(spark, path), "row")
    out = levelled_to_canonical(raw, "row")
    if not out.select("id").limit(1).count():
        raise ValueError(f"{path} has no row with a known level in column label")
    return out


#: Rows with texts in a stretch when all documents of a source are numbered.
TEXT_ROWS = 2**14


def _until(df: DataFrame, limit: int, source_col: str) -> DataFrame:
    """Rows up to the ``limit``-th key ``(_order, _tie)`` of their source; more only where that key repeats.

    Keys alone are put in order, first in salted parts of a source, of which at most ``limit`` each go on. What comes
    back to the rows is one key a source.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    keys = df.select(F.col(source_col).alias("_of"), "_order", "_tie", F.pmod("_tie", F.lit(parts)).alias("_salt"))
    for by in (["_of", "_salt"], ["_of"]):
        place = F.row_number().over(Window.partitionBy(*by).orderBy("_order", "_tie"))
        keys = keys.withColumn("_place", place).where(F.col("_place") <= limit)
    last = keys.groupBy("_of").agg(F.max(F.struct("_order", "_tie")).alias("_last"))
    met = df.join(last, F.col(source_col).eqNullSafe(F.col("_of")))
    return met.where(F.struct("_order", "_tie") <= F.col("_last")).drop("_of", "_last")


def fetch_texts(
    df: DataFrame,
    limit: int | None,
    order_col: str,
    source_col: str = "source",
    text_col: str = "text",
    spacing: int = SPACING,
) -> DataFrame:
    """The first ``limit`` documents (all, if None) of every source by ``order_col``, then without empty texts.

    The limit counts empty documents. ``doc_index`` numbers the kept ones from 0 in each source. Rows of one source with the same
    ``order_col`` are told apart by a hash of the whole row; equal rows are documents of their own, and a null source
    is a source. With a limit only the rows within it are moved, else every row once.
    """
    filled = F.coalesce(F.length(text_col) > 0, F.lit(False)).cast("long")
    keyed = df.withColumns({"_order": F.col(order_col), "_tie": F.xxhash64(*df.columns)})
    if limit is not None:
        keyed = _until(keyed, limit, source_col)
        spacing = None
    counted = running_totals(
        keyed.withColumns({"seen": F.lit(1), "filled": filled}),
        [source_col], ["_order", "_tie"], ["seen", "filled"], spacing and min(spacing, TEXT_ROWS), with_all=False,
    )
    within = F.lit(True) if limit is None else F.col("before_seen") < limit
    chosen = counted.where(within & (F.col("filled") == 1))
    return chosen.select(*df.columns, F.col("before_filled").cast("long").alias("doc_index"))
