"""The same answers at every size: forced stretches and blocks against the plain way, with awkward keys."""

import datetime as dt
import tracemalloc
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from textgrade.functions.text import SLICE, excerpts, window_text
from textgrade.llm import extraction, hashing, minmax
from textgrade.operators import neighbors
from textgrade.operators.ablation import mean_prediction, score_variants
from textgrade.operators.neighbors import nearest_gold
from textgrade.operators.pseudo import ensemble_stats, missing_inputs
from textgrade.operators.ranks import exact_quantiles, joint_ranks, unique_rank, value_ranks
from textgrade.sources.corpora import fetch_texts
from textgrade.sources.settled import TEXT_ROWS, settle_texts

START = dt.datetime(2021, 3, 4, 5, 6, 7, 890123)
KEYS = {
    "string": lambda k: f"ключ {k:03d} \"'\\",
    "double": lambda k: k / 7 - 20.0,
    "decimal(20,6)": lambda k: Decimal(k) / 64 - 3,
    "date": lambda k: START.date() + dt.timedelta(days=k),
    "timestamp": lambda k: START + dt.timedelta(seconds=k, microseconds=k * 17),
    "binary": lambda k: bytearray([k % 251, 255 - k % 7, k // 251]),
    "boolean": lambda k: k % 2 == 0,
}


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def groups(spark):
    rows = [(None if k % 4 == 3 else f"g{k % 4 % 2}", k, float(k % 11), float((k * 7) % 13)) for k in range(80)]
    return spark.createDataFrame(rows, "grp string, id int, t double, p double").cache()


@pytest.mark.parametrize("kind", KEYS)
def test_ranks_by_every_kind_of_key(spark, kind):
    rows = [("g" if k % 5 else None, KEYS[kind](k), k) for k in range(60)]
    table = spark.createDataFrame(rows, f"grp string, v {kind}, n int")
    assert rows_of(value_ranks(table, ["grp"], "v", spacing=4)) == rows_of(value_ranks(table, ["grp"], "v"))
    if kind == "boolean":
        return
    plain = unique_rank(table, ["v"], ["grp"])
    assert plain.count() == 60
    assert rows_of(unique_rank(table, ["v"], ["grp"], spacing=4)) == rows_of(plain)
    texts = table.select(F.coalesce("grp", F.lit("h")).alias("source"), "v", F.concat(F.lit("t"), "n").alias("text"))
    assert rows_of(fetch_texts(texts, 7, "v", spacing=4)) == rows_of(fetch_texts(texts, 7, "v"))
    assert fetch_texts(texts, None, "v").count() == 60


def test_null_groups_are_treated_alike(groups):
    for ranks in (
        lambda s: value_ranks(groups, ["grp"], "t", spacing=s),
        lambda s: unique_rank(groups, ["id"], ["grp"], spacing=s),
        lambda s: exact_quantiles(groups, ["grp"], "t", {"q": 0.3}, spacing=s),
    ):
        assert rows_of(ranks(4)) == rows_of(ranks(2**20))
    columns = ["grp", "t", "p", "cnt", "rank_t", "rank_p", "place_t", "place_p"]
    small, large = (joint_ranks(groups, ["grp"], "t", "p", s).select(columns) for s in (2**20, 4))
    assert rows_of(small) == rows_of(large)
    assert small.where("grp is null").count() == 0


def test_nearest_gold_does_not_depend_on_blocks(spark):
    draw = np.random.default_rng(8)
    gold = [(f"g{k:02d}", [float(x) for x in draw.normal(size=5)]) for k in range(62)] + [("none", None)]
    angles = [("a", [1.0, 0.0, 0.0, 0.0, 0.0]), ("b", [float(np.cos(2e-5)), float(np.sin(2e-5)), 0.0, 0.0, 0.0])]
    pool = [(f"p{k}", [float(x) for x in draw.normal(size=5)]) for k in range(90)]
    pool += [("tie", [float(np.cos(2e-5)), float(np.sin(2e-5)), 0.0, 0.0, 0.0]), ("null", None), ("zero", [0.0] * 5)]
    kind = "id string, embedding array<double>"
    pool, gold = spark.createDataFrame(pool, kind), spark.createDataFrame(gold + angles, kind)
    whole = rows_of(nearest_gold(pool, gold))
    assert len(whole) == 92
    for size in (400, 1200):
        assert rows_of(nearest_gold(pool, gold, block_bytes=size)) == whole
    assert nearest_gold(pool, gold.limit(0)).collect() == []
    preds = pool.select("id", F.lit("m").alias("teacher"), F.lit(1.0).alias("pred"))
    assert tuple(missing_inputs(pool, preds, pool).first()) == (0, 1)


def test_repeated_and_null_ids_keep_a_row_each(spark):
    """Pool ids 1, 1, 2 and null: a row each, whatever the blocks; null and repeated gold ids take part."""
    kind = "id long, embedding array<double>"
    pool = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (None, [-1.0, 0.0]), (None, [1.0, 0.1])], kind)
    gold = spark.createDataFrame([(7, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (8, [-1.0, 0.1]), (None, [1.0, 1.0])], kind)
    whole = rows_of(nearest_gold(pool, gold))
    assert len(whole) == 5 and sum("neighbour=7, distance=0.0)" in r for r in whole) == 2
    for size in (16, 32, 48):
        assert rows_of(nearest_gold(pool, gold, block_bytes=size)) == whole
    plan = nearest_gold(pool, gold, block_bytes=16)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("limit", [None, 1, 2, 9])
def test_documents_of_repeated_keys_and_null_sources(spark, limit):
    rows = [("s", 1, "a"), ("s", 1, "b"), (None, 1, "c"), (None, None, "d"), ("s", 2, ""), ("s", 3, None), ("s", 4, "e"), ("s", 4, "e")]
    table = spark.createDataFrame(rows, "source string, n int, text string")
    got = fetch_texts(table, limit, "n").collect()
    most = limit or 99
    assert [r.text for r in sorted((r for r in got if r.source is None), key=lambda r: r.doc_index)] == ["d", "c"][:most]
    mine = sorted((r.doc_index, r.n) for r in got if r.source == "s")
    assert mine == [(0, 1), (1, 1), (2, 4), (3, 4)][: {1: 1, 2: 2}.get(limit, 4)]
    assert sorted(r.text for r in got if r.source == "s" and r.n == 1) == ["a", "b"] or limit == 1
    cut = rows_of(fetch_texts(table, limit, "n", spacing=2))
    assert cut == rows_of(fetch_texts(table, limit, "n"))


def test_a_limit_moves_no_texts_of_other_rows(spark):
    """Keys are put in order without texts; the rows meet one key a source."""
    table = spark.range(1000).select((F.col("id") % 3).cast("string").alias("source"), "id", F.lit("long text").alias("text"))
    plan = fetch_texts(table, 5, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and fetch_texts(table, 5, "id").count() == 15


def test_repeated_predictions_are_refused(spark):
    preds = [("v", 1, "a", 1.0), ("v", 2, "a", 3.0), ("v", 1, "b", None)]
    kind = "variant string, seed int, id string, pred double"
    once, twice = (spark.createDataFrame(rows, kind) for rows in (preds, [*preds, ("v", 1, "a", 9.0)]))
    table = spark.createDataFrame([("a", 1.0, "ood_corpus")], "id string, harmonized_difficulty double, split string")
    assert {r.id: r.pred for r in mean_prediction(once).collect()} == {"a": 2.0, "b": None}
    score_variants(table, once).collect()
    teachers = twice.select("id", F.col("seed").alias("teacher"), "pred")
    for refused in (
        lambda: mean_prediction(twice),
        lambda: score_variants(table, twice),
        lambda: ensemble_stats(teachers, [1, 2]),
    ):
        with pytest.raises(PySparkException, match="several"):
            refused().collect()


def test_many_teachers(spark):
    preds = spark.range(1500).select(F.lit("x").alias("id"), F.col("id").alias("teacher"), F.lit(2.0).alias("pred"))
    row = ensemble_stats(preds, list(range(1500))).first()
    assert (row["mean"], row["std"]) == (2.0, 0.0)


def test_nearest_gold_does_not_depend_on_groups(spark, monkeypatch):
    draw = np.random.default_rng(9)
    kind = "id string, embedding array<double>"
    pool = spark.createDataFrame([(f"p{k}", [float(x) for x in draw.normal(size=5)]) for k in range(60)], kind)
    gold = spark.createDataFrame([(f"g{k:02d}", [float(x) for x in draw.normal(size=5)]) for k in range(50)], kind)
    whole = rows_of(nearest_gold(pool, gold))
    monkeypatch.setattr(neighbors, "GROUP_BYTES", 600)
    for size in (16, 200):
        assert rows_of(nearest_gold(pool, gold, block_bytes=size)) == whole


def test_closest_holds_a_tile_of_distances():
    draw = np.random.default_rng(10)
    rows, gold = draw.normal(size=(6000, 8)), draw.normal(size=(5000, 8))
    gold[4500] = gold[70]
    rows[5] = gold[70]
    rows, gold = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rows, gold))
    distance = np.round(1.0 - rows[:300] @ gold.T, neighbors.DECIMALS)
    tracemalloc.start()
    best, who = neighbors._closest(rows, np.arange(5000), gold)
    assert tracemalloc.get_traced_memory()[1] < 64 * 2**20  # it was 600 MB with a batch's distances at once
    tracemalloc.stop()
    assert who[5] == 70 and who[:300].tolist() == distance.argmin(axis=1).tolist()
    assert best[:300] == pytest.approx(np.maximum(distance.min(axis=1), 0))
    few, same = neighbors._closest(rows, np.arange(5000), gold, 64)
    assert same.tolist() == who.tolist() and few == pytest.approx(best)


def test_texts_are_packed_and_extracted_a_slice_at_a_time(spark):
    n = 2 * SLICE + 3
    texts = [None if k % 7 == 0 else "\n\n".join(f"{k} {j} " + "w " * (k % 50) for j in range(k % 9)) for k in range(n)]
    df = spark.createDataFrame([(k, t, f"<html><body><p>{k} is a page</p></body></html>" if t else None) for k, t in enumerate(texts)], "k int, text string, html string").coalesce(1)
    got = {r.k: r.w for r in df.select("k", window_text("text", 60, 90, 20).alias("w")).collect()}
    assert got == {k: None if t is None else excerpts(t, 60, 90, 20) for k, t in enumerate(texts)}
    pages = extraction.extract_main_text(df, ("k",))
    assert {r.k: r.text for r in pages.collect()} == {k: extraction.main_text(f"<html><body><p>{k} is a page</p></body></html>" if t else None) for k, t in enumerate(texts)}
    assert n > 2 * extraction.SLICE and "MapInArrow" in pages._jdf.queryExecution().executedPlan().toString()


def test_shingles_are_made_a_stretch_of_texts_at_a_time(monkeypatch):
    texts = [None if k % 9 == 4 else " ".join(f"W{k % 50}x{j * j % 97}" for j in range(k * 7 % 300)) for k in range(20000)]
    column = pa.array(texts)
    list(hashing.shingle_sets(column[:2], 5))
    tracemalloc.start()
    size = sum(len(s) for s in hashing.shingle_sets(column, 5))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert size > 1_000_000 and most < 32 * 2**20  # it was 111 MB with the words of all texts at once
    few = column.slice(3, 400)
    batch = pa.RecordBatch.from_arrays([pa.array([b"%d" % k for k in range(400)]), few], names=["wanted", "text"])
    whole = list(minmax._sets(5)([batch]))
    monkeypatch.setattr(hashing, "STRETCH", 3000)
    cut = list(minmax._sets(5)([batch]))
    assert len(whole) == 1 and len(cut) > 50
    assert pa.Table.from_batches(cut).to_pylist() == whole[0].to_pylist()
    assert [s.tolist() for s in hashing.shingle_sets(few, 5)] == [s.tolist() for t in few for s in hashing.shingle_sets(pa.array([t], pa.string()), 5)]
    assert list(minmax._sets(5)([batch.slice(0, 0)])) == [] and list(hashing.shingle_sets(pa.array([None, ""], pa.string()), 5))[1].tolist() == []


def test_workers_get_few_texts_at_a_time(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    given = spark.conf.get(key)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)])], names=["n"])

    found = [r.n for r in settle_texts(spark.range(0, 4 * TEXT_ROWS + 5, numPartitions=1).mapInArrow(sizes, "n long")).collect()]
    assert max(found) == TEXT_ROWS and sum(found) == 4 * TEXT_ROWS + 5 and spark.conf.get(key) == given
    with pytest.raises(PySparkException):
        settle_texts(spark.range(1).select(F.raise_error(F.lit("no"))))
    assert spark.conf.get(key) == given
