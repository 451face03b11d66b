import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textgrade.operators.pairs import pair_counts, pairwise_hinge
from textgrade.operators.ranks import (
    exact_quantiles,
    harmonize,
    joint_ranks,
    percentile_within_corpus,
    quantile_bin,
    running_totals,
    unique_rank,
)

WIDE, NARROW = 2**19, 120


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    n = 1500
    pdf = pd.DataFrame(
        {
            "id": [f"r{i}" for i in range(n)],
            "corpus": np.where(rng.random(n) < 0.7, "a", "b"),
            "t": rng.integers(0, 300, n).astype(float),
            "p": rng.normal(size=n).round(1),
        }
    )
    pdf.loc[rng.random(n) < 0.4, "t"] = 3.0
    pdf.loc[::17, "t"] = None
    return pdf


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(rows)
    return df.withColumn("t", F.when(~F.isnan("t"), F.col("t"))).persist()


@pytest.mark.parametrize("spacing", [WIDE, NARROW])
def test_percentile_rank_equals_pandas(frame, rows, spacing):
    out = percentile_within_corpus(frame, "t", polarity={"a": False}, out_col="h", spacing=spacing)
    got = out.toPandas().set_index("id").loc[rows.id, "h"].astype(float).to_numpy()
    want = rows.groupby("corpus").t.rank(pct=True)
    want = np.where(rows.corpus == "a", 1 - want, want)
    assert np.allclose(got, want, equal_nan=True)


def test_null_corpus_has_no_rank(spark):
    df = spark.createDataFrame([("1", None, 1.0), ("2", "x", 1.0)], "id string, corpus string, native_label double")
    got = {r.id: r.harmonized_difficulty for r in percentile_within_corpus(df).collect()}
    assert got == {"1": None, "2": 1.0}


def test_harmonize_names_and_errors(spark):
    df = spark.createDataFrame([("1", "x", 1.0), ("2", "x", None)], "id string, corpus string, native_label double")
    got = {r.id: r for r in harmonize(df).collect()}
    assert got["1"].mapping_confidence == 1.0 and got["2"].mapping_confidence is None
    assert got["2"].mapping_method == "percentile_within_corpus"
    with pytest.raises(NotImplementedError):
        harmonize(df, "isotonic")
    with pytest.raises(ValueError):
        harmonize(df, "other")


@pytest.mark.parametrize("spacing", [WIDE, NARROW, 33])
def test_unique_rank_and_totals(frame, rows, spacing):
    got = unique_rank(frame.select("id", "p"), ["p", "id"], spacing=spacing).toPandas()
    got = got.sort_values("rank")
    assert (got["rank"].to_numpy() == np.arange(1, len(rows) + 1)).all()
    assert got.p.is_monotonic_increasing and (got["rows"] == len(rows)).all()
    cells = frame.groupBy("corpus", "p").agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(cells, ["corpus"], ["p"], ["n"], spacing).toPandas()
    for _, g in totals.groupby("corpus"):
        g = g.sort_values("p")
        assert (g.before_n.to_numpy() == np.r_[0, g.n.cumsum().to_numpy()[:-1]]).all()
        assert (g.all_n == g.n.sum()).all()


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 57, 101])
def test_quantile_bins_equal_qcut(spark, n):
    df = spark.range(1, n + 1).select(F.col("id").alias("rank"), F.lit(n).cast("long").alias("rows"))
    got = df.select("rank", quantile_bin("rank", "rows", 10).alias("b")).toPandas().sort_values("rank")
    if n == 1:
        assert list(got.b) == [0]
    else:
        assert list(got.b) == list(pd.qcut(pd.Series(range(1, n + 1)), 10, labels=False))


@pytest.mark.parametrize("spacing", [WIDE, NARROW])
def test_quantiles_equal_pandas(frame, rows, spacing):
    got = exact_quantiles(frame, ["corpus"], "p", {"m": 0.5, "q": 0.13}, spacing).toPandas().set_index("corpus")
    for c, g in rows.groupby("corpus"):
        assert np.isclose(got.loc[c, "m"], g.p.median()) and np.isclose(got.loc[c, "q"], g.p.quantile(0.13))


@pytest.mark.parametrize("spacing", [WIDE, NARROW])
def test_pair_counts_equal_brute_force(frame, rows, spacing):
    ranked = joint_ranks(frame, ["corpus"], "t", "p", spacing)
    got = pair_counts(ranked, ["corpus"], "p", spacing).toPandas().set_index("corpus")
    for c, g in rows.dropna().groupby("corpus"):
        upper = np.triu_indices(len(g), 1)
        dt = np.sign(g.t.to_numpy()[:, None] - g.t.to_numpy())[upper]
        dp = np.sign(g.p.to_numpy()[:, None] - g.p.to_numpy())[upper]
        r = got.loc[c]
        assert r.concordant == (dt * dp > 0).sum() and r.discordant == (dt * dp < 0).sum()
        assert r.tied_target == (dt == 0).sum() and r.tied_pred == (dp == 0).sum()
        assert r.pairs == len(dt)


@pytest.mark.parametrize("spacing", [WIDE, NARROW])
@pytest.mark.parametrize("margin", [0.0, 0.5])
def test_hinge_loss_equals_brute_force(frame, rows, spacing, margin):
    got = pairwise_hinge(frame, ["corpus"], "t", "p", margin, spacing).toPandas().set_index("corpus")
    for c, g in rows.dropna().groupby("corpus"):
        dt = np.sign(g.t.to_numpy()[:, None] - g.t.to_numpy())
        ds = g.p.to_numpy()[:, None] - g.p.to_numpy()
        cost = np.maximum(margin - dt * ds, 0)[dt != 0]
        assert np.isclose(got.loc[c, "loss"], cost.mean())


def test_hinge_without_differing_targets_is_zero(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 1.0, 5.0), ("y", 1.0, 1.0)], "b string, t double, s double")
    got = pairwise_hinge(df, ["b"], "t", "s").collect()
    assert {r.b: r.loss for r in got} == {"x": 0.0, "y": 0.0}


def test_no_plan_puts_all_rows_on_one_task(frame):
    cut = unique_rank(frame.select("corpus", "p", "id"), ["p", "id"], ["corpus"], spacing=NARROW)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "_stretch" in plan and "SinglePartition" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("n", [1000, 30000])
def test_stretches_stay_level(spark, n):
    """Ten times the keys make ten times the stretches, not longer ones."""
    table = spark.range(n).select(F.lit("g").alias("grp"), F.expr("id * id").alias("v"), F.lit(1).alias("n"))
    cut = running_totals(table, ["grp"], ["v"], ["n"], spacing=500)
    assert cut.where("before_n <> cast(sqrt(v) as long) or all_n <> %d" % n).isEmpty()
    part = table.repartitionByRange(n // 500, "grp", "v").groupBy(F.spark_partition_id()).count()
    assert part.agg(F.max("count")).first()[0] <= 3 * 500


def test_rank_lookup_moves_no_texts(frame, monkeypatch):
    """Few ranks meet the rows where they are; many by a shuffle, with the same result."""
    rows = frame.withColumn("text", F.lit("long"))
    few = percentile_within_corpus(rows, "t", out_col="h")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    monkeypatch.setattr("textgrade.operators.ranks.is_small", lambda table: False)
    many = percentile_within_corpus(rows, "t", out_col="h")
    assert sorted(map(str, many.collect())) == sorted(map(str, few.collect()))
