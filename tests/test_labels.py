import hashlib
import math

import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from textgrade.functions.text import difficulty_proxy
from textgrade.operators.neighbors import map_to_axis, nearest_gold
from textgrade.operators.pseudo import ensemble_stats, gate_report, generate_pseudo_labels, judge_pool
from textgrade.operators.training import (
    best_epoch,
    fit_teachers,
    pointwise_loss,
    predict_teachers,
    score_rows,
    source_map,
    training_stages,
    training_view,
)
from textgrade.plans.labelling import pseudo_label_pool
from textgrade.schema import from_rows


def knots(spark, pairs):
    return spark.createDataFrame(pairs, "native_label double, harmonized_difficulty double")


def mapped(spark, preds, gold, **kw):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(preds)], "id int, pred double")
    return [r.axis for r in map_to_axis(df, gold, **kw).orderBy("id").collect()]


@pytest.mark.parametrize("held", [1000, 0])
def test_axis_extrapolates_or_clamps(spark, held):
    gold = knots(spark, [(-4.0, 0.8), (0.0, 0.6), (4.0, 0.4), (None, 0.3)])
    a = mapped(spark, [-4.0, -6.0, -8.0, 2.0, 10.0, None], gold, broadcast_knots=held)
    assert a[:5] == pytest.approx([0.8, 0.9, 1.0, 0.5, 0.1]) and a[5] is None
    clamped = mapped(spark, [-6.0, -8.0, None], gold, extrapolate=False, broadcast_knots=held)
    assert clamped == [0.8, 0.8, None]


@pytest.mark.parametrize("held", [1000, 0])
def test_axis_with_tied_end_and_single_knot(spark, held):
    tied = knots(spark, [(1.0, 0.7), (1.0, 0.7), (3.0, 0.6), (4.0, 0.2)])
    assert mapped(spark, [-5.0, 5.0, 2.0], tied, broadcast_knots=held) == pytest.approx([0.7, -0.2, 0.65])
    assert mapped(spark, [-5.0, 7.0], knots(spark, [(1.0, 0.4)]), broadcast_knots=held) == [0.4, 0.4]
    assert mapped(spark, [1.0], knots(spark, [(None, 0.4)]), broadcast_knots=held) == [None]


def vectors(spark, name, rows):
    return spark.createDataFrame([(f"{name}:{i}", [float(x) for x in v]) for i, v in enumerate(rows)], "id string, embedding array<double>")


@pytest.mark.parametrize("clustered", [True, False])
def test_neighbours_equal_brute_force_both_ways(spark, clustered):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 8))
    make = lambda n: centres[rng.integers(0, 6, n)] + 0.1 * rng.normal(size=(n, 8)) if clustered else rng.normal(size=(n, 8))
    gold, pool = make(300), make(200)
    pool[0] = 0.0
    pool[1] = gold[7]
    gold[250] = gold[7] * 3
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    distance = np.round(1 - unit(pool) @ unit(gold).T, 9)
    names = np.array([f"g:{i}" for i in range(300)])
    order = np.argsort(names)
    want = {f"p:{i}": (names[order][d[order].argmin()], max(d.min(), 0)) for i, d in enumerate(distance)}
    p, g = vectors(spark, "p", pool), vectors(spark, "g", gold)
    for kw in ({}, dict(block_bytes=2000)):
        got = {r.id: (r.neighbour, r.distance) for r in nearest_gold(p, g, **kw).collect()}
        assert set(got) == set(want)
        for k in want:
            assert got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-8)


def test_ensemble_uses_population_deviation_and_needs_all_teachers(spark):
    rows = [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 1.0), ("c", 0, 1.0), ("c", 1, None)]
    df = spark.createDataFrame(rows, "id string, teacher int, pred double")
    got = {r.id: (r.mean, r.std) for r in ensemble_stats(df, [0, 1]).collect()}
    assert got == {"a": (2.0, 1.0), "b": (None, None), "c": (None, None)}
    with pytest.raises(Exception, match="several values"):
        ensemble_stats(df.unionByName(df), [0, 1]).collect()


def world(spark, gold_labels, difficulties, se, gold_vectors, preds, pool_vectors):
    gold = from_rows(spark, [dict(id=f"clear:{i}", text="abc"[i % 3], corpus="clear", native_label=l, harmonized_difficulty=h, std_error=se) for i, (l, h) in enumerate(zip(gold_labels, difficulties))])
    pool = from_rows(spark, [dict(id=f"x:{i}", text="pq"[i], corpus="x") for i in range(len(preds))])
    long = spark.createDataFrame([(f"x:{i}", k, float(v)) for i, p in enumerate(preds) for k, v in enumerate(p)], "id string, teacher int, pred double")
    return pool, gold, long, vectors(spark, "x", pool_vectors), vectors(spark, "clear", gold_vectors)


def test_out_of_range_labels_weigh_less(spark):
    w = world(spark, [-1.0, 1.0], [0.9, 0.1], 0.5, [[1, 0], [0, 1]], [[0.0] * 3, [5.0] * 3], [[1, 0.3], [0.3, 1]])
    out = {r.id: r for r in generate_pseudo_labels(*w, k_se=100.0, max_std=10.0, dedup_cosine=0.0).collect()}
    assert out["x:1"].mapping_confidence < out["x:0"].mapping_confidence == 1.0
    assert out["x:1"].harmonized_difficulty == pytest.approx(0.1 - 0.4 * 4)


def test_se_gate_and_labels(spark):
    w = world(spark, [-2.0, 0.0, 1.0], [0.9, 0.5, 0.1], 0.4, [[1, 0], [0, 1], [1, 1]], [[-2, -2.1, -1.9], [5, 5.1, 4.9]], [[1, 0.4], [0.4, 1]])
    out = generate_pseudo_labels(*w, k_se=1.0, max_std=1.0).collect()
    assert [r.id for r in out] == ["x:0"]
    r = out[0]
    assert r.is_pseudo and r.split == "train" and r.native_scale == "clear_bt_pseudo" and 0 <= r.harmonized_difficulty <= 1
    assert r.std_error == pytest.approx(np.std([-2, -2.1, -1.9]))


def test_near_duplicates_of_gold_are_dropped(spark):
    w = world(spark, [-2.0], [0.9], 0.4, [[1, 0]], [[-2.0] * 3], [[1, 0]])
    assert generate_pseudo_labels(*w, k_se=1.0, max_std=1.0, dedup_cosine=0.05).count() == 0
    report = gate_report(judge_pool(*w, k_se=1.0, max_std=1.0)).first()
    assert (report.pool, report.near_se, report.agreed, report.near_dup, report.kept) == (1, 1, 1, 1, 0)


def test_default_agreement_gate_is_the_pool_median(spark):
    preds = [[0.0, 0.1], [0.0, 0.4]]
    w = world(spark, [0.0, 0.1], [0.9, 0.5], None, [[1, 0], [0, 1]], preds, [[1, 0.4], [0.4, 1]])
    got = {r.id: r.agreed for r in judge_pool(*w, k_se=100.0).collect()}
    assert got == {"x:0": True, "x:1": False}


def test_missing_inputs_are_an_error(spark):
    pool, gold, preds, pv, gv = world(spark, [0.0, 1.0], [0.9, 0.1], 0.4, [[1, 0], [0, 1]], [[0.0], [1.0]], [[1, 0], [0, 1]])
    with pytest.raises(ValueError, match="1 pool rows without predictions"):
        generate_pseudo_labels(pool, gold, preds.where("id = 'x:0'"), pv, gv)


def test_whole_run_removes_contamination_and_adds_gold(spark):
    pool, gold, preds, pv, gv = world(spark, [0.0, 1.0], [0.9, 0.1], 0.4, [[1, 0], [0, 1]], [[0.0, 0.0], [1.0, 1.0]], [[1, 0.5], [0.5, 1]])
    table = gold.withColumn("split", F.lit("train"))
    pool = pool.withColumn("text", F.when(F.col("id") == "x:0", " A ").otherwise(F.col("text")))
    pseudo, merged = pseudo_label_pool(table, pool, preds, pv, gv)
    assert [r.id for r in pseudo.collect()] == ["x:1"]
    assert sorted(r.id for r in merged.collect()) == ["clear:0", "clear:1", "x:1"]


def test_training_view_reserves_an_unseen_slot(spark):
    rows = [dict(id=f"{c}:{i}", text="t", corpus=c, native_label=1.0, mapping_confidence=w) for i, (c, w) in enumerate([("b", 2.0), ("a", None), ("z", -1.0)])]
    df = from_rows(spark, rows)
    sources = source_map(df.where("corpus <> 'z'"))
    got = {r.id: (r.source, r.weight) for r in training_view(df, "native_label", sources).collect()}
    assert got == {"b:0": (1, 1.0), "a:1": (0, 1.0), "z:2": (2, 0.0)}
    flat = training_view(df, "native_label", sources, confidence_weighting=False)
    assert {r.weight for r in flat.collect()} == {1.0}


def test_stages_fall_back_to_one_without_pseudo_rows(spark):
    rows = [("g1", "train", None), ("g2", "val", False), ("g3", "ood_corpus", False), ("p", "train", True)]
    df = spark.createDataFrame(rows, "id string, split string, is_pseudo boolean")
    got = {r.id: (r.stage, r.role) for r in training_stages(df).collect()}
    assert got == {"g1": ("B", "train"), "g2": ("B", "val"), "p": ("A", "train")}
    got = {r.id: r.stage for r in training_stages(df.where("id <> 'p'")).collect()}
    assert got == {"g1": "single", "g2": "single"}
    assert training_stages(df, two_stage=False).where("stage = 'single'").count() == 3


def test_losses_and_best_epoch(spark):
    df = spark.createDataFrame([("b", 1.0, 3.0, 0.5), ("b", 1.0, 1.0, 0.1)], "b string, y double, p double, w double")
    assert pointwise_loss(df, ["b"], "y", "p", "w").first().loss == pytest.approx(1.0)
    history = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.3), ("r", 3, 0.3), ("r", 4, None)], "run string, epoch int, val_rmse double")
    assert best_epoch(history, ["run"]).first().epoch == 2


def test_user_models_score_numbers_and_vectors(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "b")], "id int, text string")
    lengths = lambda: lambda texts: np.array([float(len(t)) for t in texts])
    pairs = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    assert {r.id: r.pred for r in score_rows(df, lengths).collect()} == {"1": 2.0, "2": 1.0}
    got = score_rows(df, pairs, out_col="embedding", return_type="array<double>")
    assert {r.id: r.embedding for r in got.collect()} == {"1": [2.0, 1.0], "2": [1.0, 1.0]}


def test_teachers_learn_and_offsets_vanish_for_unseen_corpora(spark):
    rows = [
        dict(id=f"c:{i}", text=("hard" if i % 2 else "easy") + f" word{i % 5}", corpus="ab"[i % 3 % 2], native_label=float(i % 2) * 4)
        for i in range(60)
    ]
    df = from_rows(spark, rows)
    teachers = fit_teachers(df, n_teachers=2, features=64)
    out = predict_teachers(teachers, df.withColumn("corpus", F.lit("unseen"))).toPandas()
    assert len(out) == 120 and out.teacher.nunique() == 2
    hard = out.id.str.slice(2).astype(int) % 2 == 1
    assert out[hard].pred.mean() > out[~hard].pred.mean() + 1


def test_teachers_equal_a_plain_solution_of_the_normal_equations(spark):
    """Everything anew in numpy: draws, hashed counts, document frequencies, ridge solution, shrunken offsets."""
    random = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(150):
        picked = list(random.choice(words, random.integers(3, 15)))
        label = 2.0 * ("w3" in picked) - picked.count("w7") + len(picked) / 5 + float(random.normal(0, 0.3))
        rows.append((f"c:{i}", " ".join(picked) + ".", "ab"[i % 3 % 2] if i % 10 else None, label if i % 11 else None))
    df = spark.createDataFrame(rows, "id string, text string, corpus string, native_label double")
    size, first = 16, 42
    out = predict_teachers(fit_teachers(df, n_teachers=3, first_seed=first, features=size), df)
    got = {(r.id, r.teacher): r.pred for r in out.collect()}
    assert len(got) == 450

    place = HashingTF(numFeatures=size)
    counts = np.zeros((150, size))
    for at, (_, text, _, _) in enumerate(rows):
        for word in text.split():
            counts[at, place.indexOf(word)] += 1
    proxy = np.array([r.p for r in df.select(difficulty_proxy("text").alias("p")).collect()])
    labels = np.array([np.nan if r[3] is None else r[3] for r in rows])
    known = ~np.isnan(labels)
    frequency = (counts[known] > 0).sum(axis=0)
    x = np.column_stack([counts * np.log((known.sum() + 1) / (frequency + 1)), proxy])
    corpora = np.array([r[2] or "" for r in rows])
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(10)])
    for seed in range(first, first + 3):
        draws = [int(hashlib.md5(f"{seed}:{r[0]}".encode()).hexdigest()[:8], 16) / 2**32 for r in rows]
        weight = np.where(known, np.searchsorted(steps, draws, side="right"), 0).astype(float)
        y = np.where(known, labels, 0.0)
        mean_x, mean_y = weight @ x / weight.sum(), weight @ y / weight.sum()
        dx, dy = x - mean_x, y - mean_y
        gram = (dx * weight[:, None]).T @ dx / weight.sum()
        spread = math.sqrt(weight @ dy**2 / weight.sum())
        slope = np.linalg.solve(gram + 0.1 / spread * np.eye(size + 1), (dx * weight[:, None]).T @ dy / weight.sum())
        plain = mean_y + dx @ slope
        for corpus in set(corpora):
            own = corpora == corpus
            plain[own] += (weight * (y - plain))[own].sum() / (weight[own].sum() + 10)
        assert np.allclose([got[r[0], seed] for r in rows], plain, atol=1e-6)
