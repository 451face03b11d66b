"""Queries over neighbours, pseudo-labels, and the data side of training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from textgrade.catalog import sql, views
from textgrade.catalog.registry import query, r6, rounded
from textgrade.operators.bootstrap import POISSON_STEPS
from textgrade.operators.neighbors import map_to_axis, nearest_gold
from textgrade.operators.pseudo import ensemble_stats, gate_report, judge_pool, missing_inputs
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

DEDUP = 0.55
STEPS = str(list(POISSON_STEPS)) + "::DOUBLE[]"


@query(
    "n1_nearest_gold",
    f"WITH {sql.GOLD_TIED}, {sql.POOL_IDS}, {sql.NEAR} SELECT id, neighbour, round(distance, 6) AS distance FROM near",
)
def nearest(spark, sf_dir):
    return rounded(nearest_gold(views.pool_vectors(spark, sf_dir), views.gold_vectors(spark, sf_dir)))


@query(
    "n1_nearest_gold_in_blocks",
    f"WITH {sql.GOLD_TIED}, {sql.POOL_IDS}, {sql.NEAR} SELECT id, neighbour, round(distance, 6) AS distance FROM near",
)
def nearest_in_blocks(spark, sf_dir):
    """Gold in many small blocks, as a set too large for one is searched; the same answer."""
    return rounded(
        nearest_gold(
            views.pool_vectors(spark, sf_dir), views.gold_vectors(spark, sf_dir),
            block_bytes=32 * 2**10,
        )
    )


@query(
    "n2_axis_tied_labels",
    f"""WITH {sql.GOLD_TIED}, {sql.POOL_IDS}, {sql.PREDS}, {sql.axis('mean', 'stats')}
    SELECT id, round(axis_value, 6) AS axis FROM placed""",
)
def axis_tied(spark, sf_dir):
    stats = ensemble_stats(views.teacher_preds(spark, sf_dir), [0, 1, 2])
    return rounded(map_to_axis(stats, views.gold(spark, sf_dir), "mean").select("id", "axis"))


AXIS_DISTINCT = f"""WITH {sql.GOLD_DISTINCT}, {sql.POOL_IDS}, {sql.PREDS}, {sql.axis('mean', 'stats')}
    SELECT id, round(axis_value, 6) AS axis FROM placed"""


@query("n2_axis_distinct_labels", AXIS_DISTINCT)
def axis_distinct(spark, sf_dir):
    stats = ensemble_stats(views.teacher_preds(spark, sf_dir), [0, 1, 2])
    return rounded(map_to_axis(stats, views.gold(spark, sf_dir, True), "mean").select("id", "axis"))


@query("n2_axis_by_join", AXIS_DISTINCT)
def axis_by_join(spark, sf_dir):
    """The way taken for more knots than a task should hold; the same answer."""
    stats = ensemble_stats(views.teacher_preds(spark, sf_dir), [0, 1, 2])
    gold = views.gold(spark, sf_dir, True)
    return rounded(map_to_axis(stats, gold, "mean", broadcast_knots=0).select("id", "axis"))


@query(
    "n3_ensemble_mean_and_std",
    f"WITH {sql.POOL_IDS}, {sql.PREDS} SELECT id, round(mean, 6) AS mean, round(std, 6) AS std FROM stats",
)
def ensemble(spark, sf_dir):
    return rounded(ensemble_stats(views.teacher_preds(spark, sf_dir), [0, 1, 2]))


@query(
    "j2_align_predictions",
    f"""WITH {sql.POOL_IDS} SELECT id, CASE WHEN vec_id % 4 <> 3 THEN round(avg(label + vec_id % (5 + k) - 2), 6) END AS mean
    FROM pool_ids, range(3) r(k) GROUP BY id, vec_id""",
)
def aligned(spark, sf_dir):
    """Pool rows keep their place; ids one teacher has not seen have no mean."""
    preds = views.teacher_preds(spark, sf_dir)
    number = F.split("id", ":")[1].cast("long")
    some = preds.where(~((number % 4 == 3) & (F.col("teacher") == 1)))
    stats = ensemble_stats(some, [0, 1, 2])
    return rounded(views.pool(spark, sf_dir).select("id").join(stats.select("id", "mean"), "id", "left"))


@query(
    "n6_alignment_check",
    f"""WITH {sql.POOL_IDS} SELECT count(*) FILTER (WHERE vec_id % 5 = 0)::BIGINT AS no_pred,
    count(*) FILTER (WHERE vec_id % 9 = 0)::BIGINT AS no_embedding FROM pool_ids""",
)
def alignment(spark, sf_dir):
    number = F.split("id", ":")[1].cast("long")
    preds = views.teacher_preds(spark, sf_dir).where(number % 5 != 0)
    vectors = views.pool_vectors(spark, sf_dir).where(number % 9 != 0)
    return missing_inputs(views.pool(spark, sf_dir), preds, vectors)


def _judged(spark, sf_dir):
    return judge_pool(
        views.pool(spark, sf_dir),
        views.gold(spark, sf_dir),
        views.teacher_preds(spark, sf_dir),
        views.pool_vectors(spark, sf_dir),
        views.gold_vectors(spark, sf_dir),
        dedup_cosine=DEDUP,
    )


@query(
    "n4_n5_q5_gates",
    f"WITH {sql.judged(DEDUP)} SELECT id, near_se, agreed, near_dup FROM judged",
)
def gates(spark, sf_dir):
    return _judged(spark, sf_dir).select("id", "near_se", "agreed", "near_dup")


@query(
    "n7_gate_report",
    f"""WITH {sql.judged(DEDUP)} SELECT count(*)::BIGINT AS pool, count(*) FILTER (WHERE near_se)::BIGINT AS near_se,
    count(*) FILTER (WHERE agreed)::BIGINT AS agreed, count(*) FILTER (WHERE near_dup)::BIGINT AS near_dup,
    (SELECT count(*) FROM kept)::BIGINT AS kept FROM judged""",
)
def report(spark, sf_dir):
    return gate_report(_judged(spark, sf_dir))


# Without the copies that repeat a gold text.
CLEAN_POOL = sql.judged(DEDUP).replace("vec_id % 40 = 0)", "vec_id % 40 = 0 AND vec_id % 80 <> 0)")
PSEUDO = f"""{CLEAN_POOL}, {sql.axis('mean', 'kept')},
    edge AS (SELECT min(native_label) AS lo, max(native_label) AS hi FROM gold),
    pseudo AS (SELECT p.id, mean AS native_label, axis_value AS h, std,
      1 / (1 + std) / (1 + greatest(0, lo - mean, mean - hi) / (hi - lo)) AS conf FROM placed p, edge)"""


@query(
    "n6_n8_pseudo_labels",
    f"""WITH {PSEUDO} SELECT id, round(native_label, 6) AS native_label, 'clear_bt_pseudo' AS native_scale,
    round(h, 6) AS harmonized_difficulty, 'pseudo_teacher' AS mapping_method, round(conf, 6) AS mapping_confidence,
    round(std, 6) AS std_error, 'train' AS split, true AS is_pseudo FROM pseudo""",
)
def pseudo_labels(spark, sf_dir):
    """The whole run: contamination, gold, gates, labels."""
    pseudo, _ = _labelled(spark, sf_dir)
    return rounded(
        pseudo.select(
            "id", "native_label", "native_scale", "harmonized_difficulty", "mapping_method",
            "mapping_confidence", "std_error", "split", "is_pseudo",
        )
    )


def _labelled(spark, sf_dir):
    # Every other copy repeats a gold text, in capitals; the rest are for the vector gate.
    repeats = F.col("id").startswith("copy:") & (F.split_part("id", F.lit(":"), F.lit(2)).cast("long") % 80 == 0)
    pool = views.pool(spark, sf_dir).withColumn(
        "text", F.when(repeats, F.upper("text")).otherwise(F.concat("text", F.lit(" of pool")))
    )
    return pseudo_label_pool(
        views.gold(spark, sf_dir),
        pool,
        views.teacher_preds(spark, sf_dir),
        views.pool_vectors(spark, sf_dir),
        views.gold_vectors(spark, sf_dir),
        dedup_cosine=DEDUP,
    )


@query(
    "u2_training_pool",
    f"""WITH {PSEUDO} SELECT is_pseudo, count(*)::BIGINT AS n, round(avg(h), 6) AS mean_difficulty FROM (
      SELECT false AS is_pseudo, axis AS h FROM gold_axis UNION ALL SELECT true, h FROM pseudo) GROUP BY 1""",
)
def pool_union(spark, sf_dir):
    _, rows = _labelled(spark, sf_dir)
    return rows.groupBy("is_pseudo").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("harmonized_difficulty")).alias("mean_difficulty")
    )


@query(
    "t1_training_view",
    f"""WITH {sql.canonical('lang')} SELECT id, native_label AS target,
    CASE language WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END::BIGINT AS source,
    CASE WHEN doc_id % 5 = 0 THEN 1 ELSE greatest(least((doc_id % 9) / 4.0 - 0.5, 1), 0) END::DOUBLE AS weight FROM canon""",
)
def view_for_training(spark, sf_dir):
    docs = views.canonical_docs(spark, sf_dir, "lang")
    d = F.split("id", ":")[1].cast("long")
    weighted = docs.withColumn("mapping_confidence", F.when(d % 5 != 0, (d % 9) / F.lit(4.0) - 0.5))
    sources = source_map(docs.where("corpus <> 'es'"))
    return training_view(weighted, "native_label", sources).select("id", "target", "source", "weight")


@query(
    "t2_training_stages",
    """SELECT CASE WHEN doc_id % 4 = 0 THEN 'A' ELSE 'B' END AS stage,
    CASE WHEN doc_id % 4 = 0 OR doc_id % 3 = 0 THEN 'train' ELSE 'val' END AS role, count(*)::BIGINT AS n
    FROM documents WHERE doc_id % 4 = 0 OR doc_id % 3 <> 2 GROUP BY ALL""",
)
def stages(spark, sf_dir):
    docs = views.canonical_docs(spark, sf_dir)
    d = F.split("id", ":")[1].cast("long")
    names = F.array(F.lit("train"), F.lit("val"), F.lit("ood_corpus"))
    rows = docs.withColumns(
        {"is_pseudo": d % 4 == 0, "split": F.element_at(names, (d % 3 + 1).cast("int"))}
    )
    return training_stages(rows).groupBy("stage", "role").agg(F.count(F.lit(1)).alias("n"))


@query(
    "t4_pointwise_loss",
    """SELECT l_returnflag AS batch, round(avg(l_discount * pow(l_extendedprice / 1000 - l_quantity, 2)), 6) AS loss
    FROM lineitem GROUP BY 1""",
)
def weighted_loss(spark, sf_dir):
    items = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("batch"),
        F.col("l_quantity").alias("y"),
        (F.col("l_extendedprice") / 1000).alias("pred"),
        F.col("l_discount").alias("w"),
    )
    return rounded(pointwise_loss(items, ["batch"], "y", "pred", "w"))


def _length_model():
    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([len(t) / 100.0 for t in texts])

    return predict


def _shape_model():
    def predict(texts: np.ndarray) -> np.ndarray:
        return np.array([[len(t) / 100.0, t.count(" ") / 10.0] for t in texts])

    return predict


@query("t5_score_rows", "SELECT doc_id::VARCHAR AS id, round(length(text) / 100.0, 6)::DOUBLE AS pred FROM documents")
def batch_scores(spark, sf_dir):
    docs = views.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    return rounded(score_rows(docs, _length_model))


@query(
    "t5_score_vectors",
    """SELECT doc_id::VARCHAR AS id, place::INTEGER AS place, round(CASE place WHEN 0 THEN length(text) / 100.0
      ELSE len(regexp_extract_all(text, ' ')) / 10.0 END, 6)::DOUBLE AS value FROM documents, range(2) r(place)""",
)
def batch_vectors(spark, sf_dir):
    docs = views.documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text")
    scored = score_rows(docs, _shape_model, out_col="vector", return_type="array<double>")
    return rounded(scored.select("id", F.posexplode("vector").alias("place", "value")))


# A ridge line on one feature; the penalty is in units of the target's deviation.
TEACHERS = f"""{sql.canonical('lang', 'quality')},
  featured AS (SELECT id, corpus, native_label AS y, {sql.proxy('text')} AS x FROM canon),
  weighed AS (SELECT teacher, corpus, x, y, len(list_filter({STEPS}, lambda s: s <= u)) AS w FROM (
    SELECT teacher, corpus, x, y, {sql.number('teacher', 'id')} / 4294967296.0::DOUBLE AS u
    FROM featured, range(42, 45) r(teacher) WHERE y IS NOT NULL)),
  means AS (SELECT teacher, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM weighed GROUP BY 1),
  slopes AS (SELECT teacher, any_value(mx) AS mx, any_value(my) AS my,
    (sum(w * (x - mx) * (y - my)) / sum(w)) / (sum(w * (x - mx) * (x - mx)) / sum(w)
      + 0.1 / sqrt(sum(w * (y - my) * (y - my)) / sum(w))) AS b FROM weighed JOIN means USING (teacher) GROUP BY 1),
  offsets AS (SELECT teacher, corpus, sum(w * (y - my - b * (x - mx))) / (sum(w) + 10) AS miss
    FROM weighed JOIN slopes USING (teacher) WHERE w > 0 GROUP BY 1, 2)"""


@query(
    "t6_t7_ridge_teachers",
    f"""WITH {TEACHERS}, asked AS (SELECT id, x, CASE WHEN corpus <> 'es' THEN corpus ELSE 'unseen' END AS corpus FROM featured)
    SELECT id, teacher::INTEGER AS teacher, round(my + b * (x - mx) + coalesce(miss, 0), 6) AS pred
    FROM asked JOIN slopes ON true LEFT JOIN offsets USING (teacher, corpus)""",
)
def ridge_teachers(spark, sf_dir):
    """Teachers on the readability proxy alone; one corpus comes under a name that training has not seen."""
    docs = views.canonical_docs(spark, sf_dir, "lang", "quality")
    teachers = fit_teachers(docs, n_teachers=3, features=0)
    renamed = F.when(F.col("corpus") != "es", F.col("corpus")).otherwise("unseen")
    return rounded(predict_teachers(teachers, docs.select("id", "text", renamed.alias("corpus"))))


@query("t6_t7_teacher_ensemble")
def teacher_ensemble(spark, sf_dir):
    """Three linear teachers with corpus offsets, fitted on labelled documents and applied to all."""
    docs = views.canonical_docs(spark, sf_dir, "lang", "quality")
    teachers = fit_teachers(docs.where("native_label is not null"), n_teachers=3, features=512)
    return rounded(predict_teachers(teachers, docs.select("id", "text", "corpus")))


@query(
    "t8_best_epoch",
    """SELECT l_returnflag AS run, l_linenumber AS epoch, val_rmse FROM (
      SELECT l_returnflag, l_linenumber, round(stddev_pop(l_quantity), 3) AS val_rmse FROM lineitem GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY val_rmse, l_linenumber) = 1""",
)
def epochs(spark, sf_dir):
    history = views.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_returnflag").alias("run"), F.col("l_linenumber").alias("epoch")
    ).agg(F.round(F.stddev_pop("l_quantity"), 3).alias("val_rmse"))
    return best_epoch(history, ["run"])
