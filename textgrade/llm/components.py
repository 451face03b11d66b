"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textgrade.llm.common import broadcast_if_small
from textgrade.sources.settled import settle


def _roots(ends: DataFrame) -> DataFrame:
    """``node, label``: where each node ends up by going on to the smallest neighbour, as long as that is smaller."""
    step = settle(ends.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("label")))
    while True:
        beyond = step.select(F.col("node").alias("next"), F.col("label").alias("far"))
        jumped = settle(
            step.join(broadcast_if_small(beyond), F.col("label") == F.col("next")).select(
                "node", F.col("far").alias("label"), (F.col("far") < F.col("label")).alias("moved")
            )
        )
        step = jumped.select("node", "label")
        if jumped.where("moved").isEmpty():
            return step


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node it can reach, for every node of a two-column link table.

    Each round draws the nodes that lead to one root together and keeps only the links between different roots, so
    links fade quickly and rounds grow with the logarithm of the number of nodes. Tables of all rounds lie in the
    shared folder. Repeated links are harmless; links of a node to itself and with a null end are left out.
    """
    a, b = (F.col(c) for c in links.columns)
    linked = settle(links.where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct())
    labels = None
    while labels is None or not linked.isEmpty():
        ends = linked.unionByName(linked.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = _roots(ends)
        to = broadcast_if_small(roots.select(F.col("node").alias("from"), F.col("label").alias("to")))
        if labels is None:
            labels = roots
        else:
            on = F.col("label") == F.col("from")
            labels = settle(labels.join(to, on, "left").select("node", F.coalesce("to", "label").alias("label")))
        one = linked.join(to, F.col("u") == F.col("from")).select(F.col("to").alias("p"), "v")
        both = one.join(to, F.col("v") == F.col("from")).select("p", F.col("to").alias("q")).where("p != q")
        linked = settle(both.select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
    return labels
