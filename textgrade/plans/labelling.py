"""From a pool and gold labels to a training table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textgrade.operators.pseudo import DEDUP_COSINE, K_SE, generate_pseudo_labels
from textgrade.operators.quality import dedup_against
from textgrade.operators.ranks import SPACING
from textgrade.schema import canonical, coerce
from textgrade.sources.settled import settle


def gold_rows(table: DataFrame, gold_corpus: str = "clear") -> DataFrame:
    """Labelled rows of the corpus that anchors the axis."""
    return table.where((F.col("corpus") == gold_corpus) & F.col("native_label").isNotNull())


def training_pool(table: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Gold train and validation rows together with the pseudo-labelled ones."""
    gold = table.where(F.col("split").isin("train", "val"))
    return canonical(coerce(gold.unionByName(pseudo)))


def pseudo_label_pool(
    table: DataFrame,
    pool: DataFrame,
    preds: DataFrame,
    pool_vectors: DataFrame,
    gold_vectors: DataFrame,
    gold_corpus: str = "clear",
    k_se: float = K_SE,
    max_std: float | None = None,
    dedup_cosine: float = DEDUP_COSINE,
    extrapolate: bool = True,
    spacing: int = SPACING,
) -> tuple[DataFrame, DataFrame]:
    """``(pseudo, training pool)``: contamination removed, gates applied, gold joined on.

    Vectors and predictions may cover more ids than are left; only those of the pool count.
    """
    clean = settle(dedup_against(pool, table))
    gold = gold_rows(table, gold_corpus)
    refs = gold_vectors.join(gold.select("id"), "id", "left_semi")
    pseudo = generate_pseudo_labels(
        clean, gold, preds, pool_vectors, refs, k_se, max_std, dedup_cosine, extrapolate,
        spacing=spacing,
    )
    return pseudo, training_pool(table, pseudo)
