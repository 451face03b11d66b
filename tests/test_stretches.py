"""Ranks and pair sums over cuts: hot values, repeated rows and groups in several stretches, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textgrade.operators import stretches
from textgrade.operators.metrics import formula_baselines, score_groups
from textgrade.operators.pairs import pairwise_hinge
from textgrade.operators.ranks import joint_ranks
from textgrade.operators.stretches import pair_sums, written_cells


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(3)
    rows = [(f"g{k % 3 // 2}", float(draw.integers(0, 4) * (k % 5 > 0)), float(draw.integers(0, 25)) / 2, int(draw.integers(1, 4))) for k in range(240)]
    rows += [("g0", -0.0, 1.0, 2), ("g2", 1.0, 1.0, 1), (None, 1.0, 2.0, 1), (None, 2.0, 3.0, 1)]
    return spark.createDataFrame(rows, "grp string, t double, p double, w long").cache()


def test_pair_sums_over_cuts(points):
    got = {r.grp: int(r.total) for r in pair_sums(points, ["grp"], "t", "p", ["w"], ["w"], 20).collect() if r.grp}
    for grp, g in points.toPandas().dropna().groupby("grp"):
        t, p, w = (g[c].to_numpy() for c in ("t", "p", "w"))
        both = (t[:, None] < t) & (p[:, None] < p)
        assert got[grp] == (w[:, None] * w)[both].sum()


def test_counts_beyond_long_stay_exact():
    n = np.array([3 * 10**9, 2 * 10**9 + 1], dtype=object)
    assert stretches.sums_both_ways(np.array([True, False]), np.array([0, 1]), [n], [n]) == [3 * 10**9 * (2 * 10**9 + 1)]


def test_ranks_are_cut_without_a_window_over_a_group(points):
    """A group of more cells than a stretch is never on one task, however few its rows would be for a window."""
    cut = joint_ranks(points, ["grp"], "t", "p", 20)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortMergeJoin" not in plan and "HashAggregate" not in plan
    whole = joint_ranks(points, ["grp"], "t", "p").select(cut.columns)
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    assert cut.where("grp is null").isEmpty() and cut.agg(F.sum("cnt")).first()[0] == 242


def test_cells_are_merged_a_slice_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(stretches, "SLICE", 50)
    rows = spark.range(0, 1000, 1, 1).select(F.lit(1.0).alias("t"), F.when(F.col("id") % 2 == 0, 2.0).alias("p"))
    cells = written_cells(rows, [], ["t", "p"])
    assert cells.agg(F.sum("cnt")).first()[0] == 1000 and cells.count() <= 40


def test_odd_scores_leave_no_loss(spark):
    rows = [("a", 1.0, float("nan")), ("a", 2.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 1.0), ("B", 1.0, 1e25), ("B", 2.0, 1e24), (None, 1.0, 2.0), (None, 2.0, 1.0)]
    got = {r.b: r.loss for r in pairwise_hinge(spark.createDataFrame(rows, "b string, t double, s double"), ["b"], "t", "s").collect()}
    assert np.isnan(got["a"]) and got["b"] == 1.0


def test_formulas_are_summed_where_the_rows_lie(spark):
    rows = [(float(k), None if k % 7 == 0 else float(k * k % 31), float("nan") if k % 5 == 0 else float(-k)) for k in range(60)]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    got = {r.reference: r for r in formula_baselines(df, "y", ["a", "b", "gone"], 8).collect()}
    table = df.toPandas()
    for c in ("a", "b"):
        own = table[["y", c]].dropna()
        assert got[c].n == len(own) and np.isclose(got[c].r2, own.corr().iloc[0, 1] ** 2)
        assert np.isclose(got[c].spearman, own.corr("spearman").iloc[0, 1])
    assert got["gone"].n == 0 and got["gone"].r2 is None
    plan = formula_baselines(df, "y", ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array(struct(reference" not in plan  # the rows are not multiplied to be counted


def test_scores_do_not_depend_on_cuts(points):
    whole, cut = (score_groups(points, ["grp"], "t", "p", spacing=s).toPandas().sort_values("grp") for s in (2**20, 30))
    assert np.allclose(whole.drop(columns="grp").astype(float), cut.drop(columns="grp").astype(float), equal_nan=True)
