import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textgrade.functions.draws import DrawBlocks, draw_number
from textgrade.operators import bootstrap
from textgrade.operators.ablation import aggregate_seeds, compare_to_full, mean_prediction, score_variants
from textgrade.operators.bootstrap import bootstrap_ci, paired_bootstrap_diff
from textgrade.operators.metrics import (
    METRICS,
    attach_predictions,
    formula_baselines,
    label_noise_floor,
    mean_predictor_rmse,
    reference_bracket,
    score_against_bracket,
    score_cells,
    score_predictions,
    solution_ceilings,
)
from textgrade.operators.ranks import SPACING

NAN, INF = float("nan"), float("inf")


def table(spark, **columns):
    names = list(columns)
    types = ", ".join(f"`{n}` {'string' if isinstance(columns[n][0], str) else 'double'}" for n in names)
    return spark.createDataFrame(list(zip(*columns.values())), types)


def brute(y, p):
    """All metrics of two lists, pair by pair."""
    pairs = [(a, b) for a, b in zip(y, p) if a is not None and b is not None and math.isfinite(a) and math.isfinite(b)]
    n = len(pairs)
    out = dict.fromkeys(METRICS)
    if n:
        t, q = (np.array(x) for x in zip(*pairs))
        out.update(rmse=np.sqrt(np.mean((t - q) ** 2)), mae=np.mean(abs(t - q)), mean_signed_error=np.mean(q - t))
        rt, rq = pd.Series(t).rank(), pd.Series(q).rank()
        if n >= 2:
            out["rank_rmse"] = np.sqrt(np.mean((rt / n - rq / n) ** 2))
        iu = np.triu_indices(n, 1)
        dt, dq = np.sign(t[:, None] - t)[iu], np.sign(q[:, None] - q)[iu]
        if (dt != 0).any():
            out["pairwise_acc"] = np.mean(dt[dt != 0] == dq[dt != 0])
        if n >= 3 and rt.std() and rq.std():
            out["spearman"] = rt.corr(rq)
            out["kendall"] = np.sum(dt * dq) / np.sqrt(np.sum(dt != 0) * np.sum(dq != 0))
    return out


CASES = {
    "plain": ([1.0, 2.0, 3.0, 4.0], [1.1, 1.9, 3.2, 3.8]),
    "ties": ([1.0, 1.0, 2.0, 2.0, 5.0], [3.0, 1.0, 3.0, 2.0, 2.0]),
    "constant target": ([2.0, 2.0, 2.0], [1.0, 2.0, 3.0]),
    "constant pred": ([1.0, 2.0, 3.0], [5.0, 5.0, 5.0]),
    "two rows": ([1.0, 2.0], [2.0, 1.0]),
    "one row": ([1.0], [4.0]),
    "gaps": ([1.0, None, NAN, INF, 5.0, 6.0, 7.0], [1.0, 2.0, 3.0, 4.0, None, -INF, 0.0]),
    "nothing": ([None, NAN], [1.0, 2.0]),
}


@pytest.mark.parametrize("spacing", [SPACING, 2])
def test_scores_equal_brute_force_on_edge_cases(spark, spacing):
    rows = [(g, a, b) for g, (y, p) in CASES.items() for a, b in zip(y, p)] + [(None, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "g string, y double, p double")
    out = score_against_bracket(df, "p", "y", "g", spacing=spacing).collect()
    got = {r.group: r for r in out}
    assert set(got) == {"ALL", *CASES}
    everything = list(zip(*[(a, b) for _, a, b in rows]))
    for name, (y, p) in {**CASES, "ALL": everything}.items():
        want = brute(y, p)
        for m in METRICS:
            a, b = got[name][m], want[m]
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-12)), (name, m, a, b)
        assert got[name].n == sum(a is not None and math.isfinite(a) for a in y)


def test_a_group_named_all_stays_apart(spark):
    df = table(spark, g=["ALL", "ALL", "b"], y=[1.0, 2.0, 3.0], p=[1.0, 2.0, 3.0])
    got = {(r.is_all, r.group): r.n for r in score_against_bracket(df, "p", "y", "g").collect()}
    assert got == {(True, "ALL"): 3, (False, "ALL"): 2, (False, "b"): 1}


def test_rank_rmse_ignores_scale(spark):
    y = [1.0, 2.0, 3.0, 4.0, 5.0]
    good = score_predictions(table(spark, y=y, p=[10 * v + 100 for v in y]), "y", "p").first()
    bad = score_predictions(table(spark, y=y, p=y[::-1]), "y", "p").first()
    assert good.rank_rmse < 1e-9 and good.rmse > 100 and bad.rank_rmse > good.rank_rmse
    assert good.spearman == pytest.approx(1) and good.pairwise_acc == 1


def test_mean_predictor_is_population_deviation(spark):
    df = table(spark, y=[1.0, 2.0, 3.0, 4.0, 5.0, NAN])
    assert mean_predictor_rmse(df, "y").first().rmse == pytest.approx(np.std([1, 2, 3, 4, 5]))


def test_bracket_with_absent_and_short_columns(spark):
    df = table(spark, y=[1.0, 2.0, 3.0, 4.0], f=[4.0, 3.0, 2.0, 1.5], g=[1.0, 2.0, NAN, NAN])
    got = {r.reference: r for r in formula_baselines(df, "y", ["f", "g", "gone"]).collect()}
    assert got["f"].spearman == pytest.approx(-1) and got["f"].r2 == pytest.approx(np.corrcoef([1, 2, 3, 4], [4, 3, 2, 1.5])[0, 1] ** 2)
    assert (got["g"].spearman, got["g"].r2, got["g"].n) == (None, None, 2)
    assert (got["gone"].spearman, got["gone"].r2, got["gone"].n) == (None, None, 0)
    assert {r.reference: r.n for r in solution_ceilings(df, "y", ["gone"]).collect()} == {"gone": 0}
    long = reference_bracket(df, "y", "se", ["f"], ["g"]).collect()
    assert len(long) == 1 + 2 + 2 + 2
    assert {r.value for r in long if r.section == "noise_floor"} == {None}
    noise = label_noise_floor(table(spark, se=[0.1, 0.2, 0.6, NAN]), "se").first()
    assert noise.mean_se == pytest.approx(0.3) and noise.median_se == pytest.approx(0.2)


def test_predictions_join_on_text_ids(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    preds = spark.createDataFrame([("2", 0.5), ("3", 0.1)], "id string, pred double")
    assert [tuple(r) for r in attach_predictions(rows, preds).collect()] == [(2, "b", 0.5)]


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(0)
    t = rng.normal(size=200)
    pdf = pd.DataFrame({"id": [str(i) for i in range(200)], "t": t, "full": t + rng.normal(scale=0.3, size=200), "variant": rng.normal(size=200)})
    return spark.createDataFrame(pdf)


@pytest.mark.parametrize("mode", ["exact", "poisson"])
def test_paired_bootstrap_sees_the_better_model(noisy, mode):
    s = paired_bootstrap_diff(noisy, "id", "t", "full", "variant", n_boot=200, mode=mode).first()
    assert s.delta > 0 and s.ci_lo < s.delta < s.ci_hi and s.p_full_not_better < 0.05 and s.mode == mode
    s = paired_bootstrap_diff(noisy, "id", "t", "full", "variant", "rmse", n_boot=100, mode=mode).first()
    assert s.delta > 0 and s.p_full_not_better < 0.05


@pytest.mark.parametrize("metric", ["spearman", "rmse", "kendall"])
@pytest.mark.parametrize("mode", ["exact", "poisson"])
def test_interval_is_that_of_an_independent_bootstrap(noisy, metric, mode):
    pdf = noisy.toPandas()
    rng = np.random.default_rng(3)
    reps = [brute(d.t, d.full)[metric] for d in (pdf.iloc[rng.integers(0, 200, 200)] for _ in range(200))]
    lo, hi = np.percentile(reps, [2.5, 97.5])
    got = bootstrap_ci(noisy, "id", "t", "full", metric, n_boot=200, mode=mode).first()
    assert got.point == pytest.approx(brute(pdf.t, pdf.full)[metric])
    assert abs(got.ci_lo - lo) < 0.35 * (hi - lo) and abs(got.ci_hi - hi) < 0.35 * (hi - lo)


def test_bootstrap_does_not_depend_on_partitioning(noisy):
    a = bootstrap_ci(noisy.coalesce(1), "id", "t", "full", "rmse", n_boot=20).first()
    b = bootstrap_ci(noisy.repartition(9), "id", "t", "full", "rmse", n_boot=20).first()
    assert a.ci_lo == pytest.approx(b.ci_lo) and a.mode == "exact"


def test_seed_table_sorts_by_spearman(spark):
    rows = [("plain", 7, 0.61, 0.44), ("full", 7, 0.74, 0.31), ("full", 8, 0.78, 0.28), ("lone", 7, 0.2, 0.8)]
    out = aggregate_seeds(spark.createDataFrame(rows, "variant string, seed int, spearman double, rmse double")).collect()
    assert [r.variant for r in out] == ["full", "plain", "lone"]
    assert out[0].seeds == 2 and out[0].spearman_std == pytest.approx(np.std([0.74, 0.78], ddof=1))
    assert out[1].spearman_std is None


def test_variants_against_full(spark):
    rng = np.random.default_rng(1)
    n = 120
    t = rng.normal(size=n)
    gold = spark.createDataFrame([(str(i), float(v), "ood_corpus" if i % 2 else "train") for i, v in enumerate(t)], "id string, harmonized_difficulty double, split string")
    rows = [
        (v, s, str(i), float(t[i] + rng.normal(scale=w)))
        for v, w in (("full", 0.2), ("worse", 2.0))
        for s in (1, 2)
        for i in range(n)
        if not (v == "worse" and i == 1)
    ]
    preds = spark.createDataFrame(rows, "variant string, seed int, id string, pred double")
    scores = score_variants(gold, preds).toPandas()
    assert len(scores) == 4 and (scores.n == 60).all()
    assert scores.groupby("variant").spearman.mean()["full"] > scores.groupby("variant").spearman.mean()["worse"]
    assert mean_prediction(preds).count() == 2 * n - 1
    out = compare_to_full(gold, preds, n_boot=100).collect()
    assert [r.variant for r in out] == ["worse"] and out[0].significant and out[0].delta > 0


def _by_rows(df, values, metric, n_boot, mode, spacing=2**20):
    """Replicate scores with a row per replicate, in place of blocks."""
    rows = bootstrap._positions(df, ["g"], "id", values, spacing)
    reps = bootstrap.resample(rows, ["g"], values, n_boot, 42, mode)
    out = {}
    for at, pred in enumerate(values[1:]):
        for r in score_cells(reps, ["g", "rep"], values[0], pred, (metric,)).collect():
            out[r.g, r.rep, at] = r[metric]
    return out


@pytest.mark.parametrize(
    "metric, mode, spacing", [("spearman", "exact", 2**20), ("spearman", "poisson", 160), ("rank_rmse", "exact", 160), ("mae", "exact", 160)]
)
def test_blocks_score_as_single_replicates_do(spark, metric, mode, spacing):
    rng = np.random.default_rng(5)
    n = 70
    pdf = pd.DataFrame({
        "g": ["hot"] * 58 + ["few"] * 10 + ["two"] * 2,
        "id": [str(i) for i in range(n)],
        "t": rng.integers(0, 6, n).astype(float),  # ties
        "a": rng.normal(size=n),
        "b": [1.5] * n,  # never a rank correlation
    })
    df = spark.createDataFrame(pdf)
    want = _by_rows(df, ["t", "a", "b"], metric, 21, mode)
    rows = bootstrap._positions(df, ["g"], "id", ["t", "a", "b"], spacing)
    drawn = bootstrap.resample_blocks(rows, ["g"], ["t", "a", "b"], 21, 42, mode)
    scores = bootstrap.score_blocks(drawn, ["g"], "t", ["a", "b"], metric, 21, spacing).collect()
    got = {(r.g, r.rep, at): v for r in scores for at, v in enumerate(r.scores)}
    assert {r.rep for r in scores} == set(range(21))
    for key in got:
        if want.get(key) is None:
            assert got[key] is None
        else:
            assert got[key] == pytest.approx(want[key], abs=1e-9)
    assert set(want) <= set(got) and any(v is not None for v in got.values())


def test_no_exchange_has_a_row_per_replicate(noisy):
    rows = bootstrap._positions(noisy.withColumn("g", F.lit(0)), ["g"], "id", ["t", "full"], 2**20)
    for mode in ("exact", "poisson"):
        drawn = bootstrap.resample_blocks(rows, ["g"], ["t", "full"], 40, 42, mode)
        plan = drawn._jdf.queryExecution().executedPlan().toString()
        keys = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert not any("rep#" in line for line in keys)
        # counts are summed up where the lists of draws lie: one exchange for the lists, none for the codes
        assert sum("part#" in line for line in keys) == (1 if mode == "exact" else 0)
    plain = [tuple(r) for r in bootstrap_ci(noisy.limit(0), "id", "t", "full", n_boot=3).collect()]
    assert plain == []


def test_paired_blocks_do_not_depend_on_the_stretches(noisy):
    a = paired_bootstrap_diff(noisy, "id", "t", "full", "variant", n_boot=20).first()
    b = paired_bootstrap_diff(noisy.repartition(5), "id", "t", "full", "variant", n_boot=20, spacing=640).first()
    assert tuple(a)[:4] == pytest.approx(tuple(b)[:4])


def test_draws_of_blocks_are_those_of_columns(spark):
    keys = [None, "", "é", "y" * 31, "z" * 32, "a" * 200, *[str(k) for k in range(120)]]
    rows = spark.createDataFrame(list(enumerate(keys)), "at int, key string")
    for seed, reps in ((42, [0, 9, 10, 1999]), (10**30, [7])):
        drawn = rows.select("at", *[draw_number(seed, F.lit(r), "key").alias(f"r{r}") for r in reps]).orderBy("at").collect()
        for r in reps:
            (_, got), = DrawBlocks(pa.array(keys)).numbers(seed, range(r, r + 1))
            assert got.tolist() == [row[f"r{r}"] for row in drawn]


@pytest.mark.parametrize(
    "metric, mode", [("spearman", "exact"), ("spearman", "poisson"), ("rank_rmse", "exact"), ("rmse", "exact"), ("mae", "poisson"), ("rmse", "poisson")]
)
def test_held_replicates_score_as_single_ones_do(spark, metric, mode, monkeypatch):
    """Groups that fit a task are scored without a shuffled row for each draw or block; so are sums under Poisson counts."""
    rng = np.random.default_rng(6)
    n = 70
    pdf = pd.DataFrame({
        "g": ["hot"] * 58 + ["few"] * 10 + ["two"] * 2,
        "id": [str(i) for i in range(n)],
        "t": rng.integers(0, 6, n).astype(float),
        "a": rng.normal(size=n),
        "b": [1.5] * n,
    })
    df = spark.createDataFrame(pdf)
    want = _by_rows(df, ["t", "a", "b"], metric, 21, mode)
    monkeypatch.setattr(bootstrap, "PARTIAL_SUMS", 30)
    for blocks in ("resample", "resample_blocks"):
        monkeypatch.setattr(bootstrap, blocks, None)
    rows = bootstrap._positions(df, ["g"], "id", ["t", "a", "b"], 2**20)
    scores = bootstrap._replicate_scores(rows, ["g"], "t", ["a", "b"], metric, 21, 42, mode, 2**20).collect()
    got = {(r.g, r.rep, at): v for r in scores for at, v in enumerate(r.scores)}
    assert len(got) == 3 * 21 * 2 and set(want) <= set(got)
    for key, v in got.items():
        assert v == (None if want.get(key) is None else pytest.approx(want[key], abs=1e-9))


def test_groups_beyond_a_task_are_scored_in_blocks(noisy, monkeypatch):
    held = bootstrap_ci(noisy, "id", "t", "full", n_boot=20).first()
    monkeypatch.setattr(bootstrap, "score_replicates", None)
    assert tuple(bootstrap_ci(noisy, "id", "t", "full", n_boot=20, spacing=16).first()) == pytest.approx(tuple(held))
