"""Queries over ranks, splits, samples, metrics, bootstraps and ablations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textgrade.catalog import sql, views
from textgrade.catalog.registry import query, rounded
from textgrade.functions.draws import DRAW_RANGE, draw_number
from textgrade.functions.text import window_text
from textgrade.operators.ablation import (
    aggregate_seeds,
    compare_to_full,
    mean_prediction,
    score_variants,
)
from textgrade.operators.bootstrap import bootstrap_ci, paired_bootstrap_diff
from textgrade.operators.metrics import (
    attach_predictions,
    formula_baselines,
    label_noise_floor,
    mean_predictor_rmse,
    reference_bracket,
    score_against_bracket,
    score_groups,
    score_predictions,
    solution_ceilings,
)
from textgrade.operators.pairs import pairwise_hinge
from textgrade.operators.ranks import (
    adjacent_knots,
    exact_quantiles,
    harmonize,
    joint_ranks,
    percentile_within_corpus,
    unique_rank,
    value_ranks,
)
from textgrade.operators.sampling import difficulty_bins, select_diverse
from textgrade.operators.splits import assign_splits, cv_folds, group_id
from textgrade.sources.settled import settle

PERCENT = """ranked AS (
  SELECT id, CASE WHEN corpus = 'en' THEN 1 - r / n ELSE r / n END AS h FROM (
    SELECT id, corpus, {rank} AS r, count(*) OVER (PARTITION BY corpus) AS n
    FROM canon WHERE native_label IS NOT NULL))"""
PERCENT = PERCENT.format(rank=sql.avg_rank("native_label", "corpus"))


@query(
    "r1_percentile_rank_with_ties",
    f"""WITH {sql.canonical('lang', 'quality')}, {PERCENT}
    SELECT id, round(h, 6) AS harmonized_difficulty FROM canon LEFT JOIN ranked USING (id)""",
)
def percentile_ties(spark, sf_dir):
    docs = views.canonical_docs(spark, sf_dir, "lang", "quality").select("id", "corpus", "native_label")
    out = percentile_within_corpus(docs, polarity=views.POLARITY_BY_LANG)
    return rounded(out.select("id", "harmonized_difficulty"))


@query(
    "r1_percentile_rank_continuous",
    f"""WITH {sql.canonical('lang')}, {PERCENT}
    SELECT id, round(h, 6) AS harmonized_difficulty FROM canon LEFT JOIN ranked USING (id)""",
)
def percentile_continuous(spark, sf_dir):
    docs = views.canonical_docs(spark, sf_dir, "lang").select("id", "corpus", "native_label")
    out = percentile_within_corpus(docs, polarity=views.POLARITY_BY_LANG)
    return rounded(out.select("id", "harmonized_difficulty"))


@query(
    "r1_value_ranks_large",
    f"""SELECT DISTINCT l_returnflag AS slice, l_extendedprice AS p,
    {sql.avg_rank('l_extendedprice', 'l_returnflag')} AS avg_rank,
    count(*) OVER (PARTITION BY l_returnflag)::BIGINT AS rows FROM lineitem""",
)
def ranks_large(spark, sf_dir):
    ranks = value_ranks(views.metric_large(spark, sf_dir), ["slice"], "p")
    return ranks.select("slice", "p", "avg_rank", "rows")


@query(
    "r2_harmonize",
    f"""WITH {sql.canonical('lang', 'quality')}, {PERCENT}
    SELECT id, round(h, 6) AS harmonized_difficulty, 'percentile_within_corpus' AS mapping_method,
    CASE WHEN h IS NOT NULL THEN 1.0::DOUBLE END AS mapping_confidence FROM canon LEFT JOIN ranked USING (id)""",
)
def harmonized(spark, sf_dir):
    docs = views.canonical_docs(spark, sf_dir, "lang", "quality")
    out = harmonize(docs, polarity=views.POLARITY_BY_LANG)
    return rounded(out.select("id", "harmonized_difficulty", "mapping_method", "mapping_confidence"))


PROXIES = f"""{sql.PARAGRAPHS}, {sql.chunks('paras')},
    rows_ AS (SELECT 'docs:' || k || ':' || chunk AS id, lang AS corpus, {sql.proxy('c.text')} AS proxy
      FROM chunks c JOIN documents ON k = doc_id),
    ranked AS (SELECT *, row_number() OVER (ORDER BY proxy, id) AS r, count(*) OVER () AS n FROM rows_),
    binned AS (SELECT *, greatest(((r - 1) * 10 + n - 2) // greatest(n - 1, 1), 1) - 1 AS bin FROM ranked)"""


def _chunk_rows(spark, sf_dir):
    docs = views.paragraph_docs(spark, sf_dir).select("doc_id", "lang", window_text("text").alias("w"))
    rows = docs.select("doc_id", "lang", F.posexplode_outer("w").alias("chunk", "text"))
    rows = rows.where("text is not null").select(
        F.concat_ws(":", F.lit("docs"), "doc_id", "chunk").alias("id"), F.col("lang").alias("corpus"), "text"
    )
    return settle(rows)


@query(
    "r3_r4_unique_rank_and_bins",
    f"WITH {PROXIES} SELECT id, r::BIGINT AS rank, bin::INTEGER AS bin FROM binned",
)
def rank_and_bins(spark, sf_dir):
    return difficulty_bins(_chunk_rows(spark, sf_dir), 10).select("id", "rank", "bin")


@query(
    "r5_joint_ranks",
    f"""WITH {sql.SMALL}, clean AS (SELECT * FROM small WHERE p IS NOT NULL)
    SELECT DISTINCT slice, t, p, {sql.avg_rank('t', 'slice')} AS rank_t, {sql.avg_rank('p', 'slice')} AS rank_p FROM clean""",
)
def joint(spark, sf_dir):
    out = joint_ranks(views.metric_small(spark, sf_dir), ["slice"], "t", "p")
    return out.select("slice", "t", "p", "rank_t", "rank_p")


@query(
    "r6_adjacent_knots",
    f"""WITH {sql.GOLD_TIED}, k AS (SELECT native_label AS x, any_value(axis) AS y, count(*)::BIGINT AS ties FROM gold_axis GROUP BY 1)
    SELECT row_number() OVER (ORDER BY x) AS knot, x, round(y, 6) AS y, ties, lead(x) OVER (ORDER BY x) AS next_x,
      round((lead(y) OVER (ORDER BY x) - y) / (lead(x) OVER (ORDER BY x) - x), 6) AS slope FROM k""",
)
def knots(spark, sf_dir):
    out = adjacent_knots(views.gold(spark, sf_dir), "native_label", "harmonized_difficulty")
    return rounded(out.select("knot", "x", "y", "ties", "next_x", "slope"))


@query(
    "rk_exact_quantiles",
    """SELECT l_returnflag AS slice, round(quantile_cont(l_extendedprice, 0.5), 6) AS median,
    round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1""",
)
def quantiles(spark, sf_dir):
    return rounded(
        exact_quantiles(views.metric_large(spark, sf_dir), ["slice"], "p", {"median": 0.5, "p90": 0.9})
    )


@query(
    "rk_global_row_numbers",
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders""",
)
def global_numbers(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey")
    return unique_rank(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "rank")


SPLIT = """based AS (SELECT *, CASE WHEN native_label IS NULL THEN 'unlabeled' WHEN format_type = 'poetry' THEN 'ood_format'
    WHEN corpus IN ('fr') THEN 'ood_corpus' ELSE 'train' END AS base FROM canon),
  drawn AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY {draw}, id) AS r,
    count(*) OVER (PARTITION BY base) AS m FROM based),
  splits AS (SELECT *, CASE WHEN base = 'train' AND r <= floor(m * 0.1::DOUBLE) THEN 'val' ELSE base END AS split FROM drawn)"""
SPLIT = SPLIT.format(draw=sql.draw("'42'", "id"))


@query("l1_assign_splits", f"WITH {sql.canonical('lang', 'quality')}, {SPLIT} SELECT id, split FROM splits")
def splits(spark, sf_dir):
    docs = views.canonical_docs(spark, sf_dir, "lang", "quality")
    return assign_splits(docs, ["fr"], ["poetry"]).select("id", "split")


@query(
    "l1_assign_splits_by_article",
    f"""WITH canon AS (SELECT 'docs:' || conv_id || ':' || role || ':' || turn AS id, 'docs:' || conv_id AS unit FROM conversations),
    units AS (SELECT unit, row_number() OVER (ORDER BY {sql.draw("'42'", 'unit')}, unit) AS r, count(*) OVER () AS m
      FROM (SELECT DISTINCT unit FROM canon))
    SELECT id, CASE WHEN r <= floor(m * 0.1::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM canon JOIN units USING (unit)""",
)
def splits_by_article(spark, sf_dir):
    turns = _articles(spark, sf_dir).withColumn("native_label", F.lit(1.0))
    return assign_splits(turns, group_safe=True).select("id", "split")


ARTICLES = """arts AS (SELECT 'docs:' || conv_id || ':' || role || ':' || turn AS id, 'docs:' || conv_id AS grp FROM conversations),
  sized AS (SELECT grp, row_number() OVER (ORDER BY count(*) DESC, grp) - 1 AS r FROM arts GROUP BY grp)"""


@query(
    "l2_group_ids",
    f"WITH {ARTICLES} SELECT grp AS group_id, count(*)::BIGINT AS n FROM arts GROUP BY grp",
)
def groups(spark, sf_dir):
    return _articles(spark, sf_dir).groupBy(group_id("id").alias("group_id")).agg(F.count(F.lit(1)).alias("n"))


def _articles(spark, sf_dir):
    turns = views.table(spark, sf_dir, "conversations")
    return turns.select(
        F.concat_ws(":", F.lit("docs"), "conv_id", "role", "turn").alias("id"), F.lit("train").alias("split")
    )


@query(
    "l3_group_folds",
    f"""WITH {ARTICLES} SELECT id, grp AS fold_group,
    CASE WHEN r % 10 < 5 THEN r % 10 ELSE 9 - r % 10 END::INTEGER AS fold FROM arts JOIN sized USING (grp)""",
)
def folds(spark, sf_dir):
    return cv_folds(_articles(spark, sf_dir)).select("id", "fold_group", "fold")


@query(
    "l4_select_diverse",
    f"""WITH {PROXIES},
    per AS (SELECT greatest(600 // count(*), 1) AS per FROM (SELECT DISTINCT corpus, bin FROM binned))
    SELECT id FROM binned, per QUALIFY row_number() OVER (PARTITION BY corpus, bin ORDER BY {sql.draw("'42'", 'id')}, id) <= per OR n <= 600""",
)
def diverse(spark, sf_dir):
    return select_diverse(_chunk_rows(spark, sf_dir), 600, 10).select("id")


@query(
    "j1_attach_predictions",
    """SELECT o_orderkey::VARCHAR AS id, o_custkey AS k, round(l, 6) AS pred FROM orders JOIN (
    SELECT l_orderkey, sum(l_quantity) AS l FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) ON o_orderkey = l_orderkey""",
)
def attached(spark, sf_dir):
    items = views.table(spark, sf_dir, "lineitem").where("l_linenumber > 2")
    preds = items.groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("pred"))
    rows = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    joined = attach_predictions(rows, preds)
    return rounded(joined.select(F.col("id").cast("string").alias("id"), "k", "pred"))


ALL_AND_SLICES = f"""{sql.SMALL}, slices AS (
      SELECT true AS is_all, 'ALL' AS slice, t, p FROM small
      UNION ALL SELECT false, slice, t, p FROM small WHERE slice IS NOT NULL)"""
SCORE_COLUMNS = """round(spearman, 6) AS spearman, round(kendall, 6) AS kendall, round(pairwise_acc, 6) AS pairwise_acc,
    round(rank_rmse, 6) AS rank_rmse, round(rmse, 6) AS rmse, round(mae, 6) AS mae,
    round(mean_signed_error, 6) AS mean_signed_error, n_all::BIGINT AS n"""


@query(
    "m6_score_predictions",
    f"""WITH {sql.SMALL}, one AS (SELECT 1 AS g, t, p FROM small), {sql.scores('one', 'g')}
    SELECT {SCORE_COLUMNS} FROM scored""",
)
def scored(spark, sf_dir):
    return rounded(score_predictions(views.metric_small(spark, sf_dir), "t", "p"))


@query(
    "m7_score_against_bracket",
    f"""WITH {ALL_AND_SLICES}, {sql.scores('slices', 'is_all, slice')}
    SELECT is_all, slice AS "group", {SCORE_COLUMNS} FROM scored""",
)
def bracket_scores(spark, sf_dir):
    return rounded(score_against_bracket(views.metric_small(spark, sf_dir), "p", "t", "slice"))


@query(
    "m1_value_metrics_large",
    """SELECT l_returnflag AS slice, round(sqrt(avg(pow(l_quantity - l_extendedprice, 2))), 6) AS rmse,
    round(avg(abs(l_quantity - l_extendedprice)), 6) AS mae, round(avg(l_extendedprice - l_quantity), 6) AS mean_signed_error,
    count(*)::BIGINT AS n FROM lineitem GROUP BY 1""",
)
def value_metrics_large(spark, sf_dir):
    rows = views.metric_large(spark, sf_dir)
    return rounded(score_groups(rows, ["slice"], "t", "p", ("rmse", "mae", "mean_signed_error")))


@query(
    "m2_m5_rank_metrics_large",
    f"""WITH big AS (SELECT l_returnflag AS slice, l_quantity AS t, l_extendedprice AS p FROM lineitem),
    {sql.scores('big', 'slice', pairs=False)}
    SELECT slice, round(spearman, 6) AS spearman, round(rank_rmse, 6) AS rank_rmse, n_all::BIGINT AS n FROM scored""",
)
def rank_metrics_large(spark, sf_dir):
    rows = views.metric_large(spark, sf_dir)
    return rounded(score_groups(rows, ["slice"], "t", "p", ("spearman", "rank_rmse")))


@query(
    "m3_m4_pair_metrics_large",
    """WITH big AS (SELECT l_returnflag AS slice, l_quantity AS t, l_extendedprice AS p FROM lineitem),
    a AS (SELECT slice, t, p, count(*) AS c FROM big GROUP BY ALL),
    c AS (SELECT x.slice, sum(x.c * y.c) FILTER (WHERE x.p > y.p) AS con, sum(x.c * y.c) FILTER (WHERE x.p < y.p) AS dis,
      sum(x.c * y.c) AS ordered FROM a x JOIN a y ON x.slice = y.slice AND x.t > y.t GROUP BY x.slice),
    n AS (SELECT slice, count(*)::DOUBLE AS n FROM big GROUP BY slice),
    ty AS (SELECT slice, sum(c * (c - 1) / 2) AS ty FROM (SELECT slice, p, count(*)::DOUBLE AS c FROM big GROUP BY ALL) GROUP BY slice)
    SELECT slice, round((con - dis) / (sqrt(ordered::DOUBLE) * sqrt(n * (n - 1) / 2 - ty)), 6) AS kendall,
      round(con::DOUBLE / ordered, 6) AS pairwise_acc, n::BIGINT AS n FROM c JOIN n USING (slice) JOIN ty USING (slice)""",
)
def pair_metrics_large(spark, sf_dir):
    """Exact pair counts of whole slices, without forming a pair."""
    rows = views.metric_large(spark, sf_dir)
    return rounded(score_groups(rows, ["slice"], "t", "p", ("kendall", "pairwise_acc")))


@query("m8_mean_predictor_rmse", "SELECT round(stddev_pop(l_extendedprice), 6) AS rmse FROM lineitem")
def mean_predictor(spark, sf_dir):
    return rounded(mean_predictor_rmse(views.wide_items(spark, sf_dir), "target"))


@query(
    "m9_label_noise_floor",
    "SELECT round(avg(l_tax), 6) AS mean_se, round(median(l_tax), 6) AS median_se FROM lineitem",
)
def noise_floor(spark, sf_dir):
    return rounded(label_noise_floor(views.wide_items(spark, sf_dir), "se"))


FORMULAS = ["formula_a", "formula_b", "formula_gone"]
SOLUTIONS = ["solution_a", "solution_b", "solution_gone"]


def _long(columns: dict[str, str]) -> str:
    parts = [f"SELECT '{name}' AS reference, l_extendedprice AS t, {col} AS p FROM lineitem" for name, col in columns.items()]
    return "long AS (" + " UNION ALL ".join(parts) + ")"


FORMULA_SQL = f"""{_long({'formula_a': 'l_quantity', 'formula_b': 'l_discount'})}, {sql.scores('long', 'reference', pairs=False)},
    r2 AS (SELECT reference, pow(corr(t, p), 2) AS r2 FROM long GROUP BY 1),
    formulas AS (SELECT reference, spearman, r2, n_all::BIGINT AS n FROM scored JOIN r2 USING (reference)
      UNION ALL SELECT 'formula_gone', NULL, NULL, 0)"""
SOLUTION_SQL = f"""{_long({'solution_a': 'l_extendedprice + l_tax', 'solution_b': 'l_extendedprice * (1 - l_discount)'})},
    {sql.scores('long', 'reference', pairs=False)},
    solutions AS (SELECT reference, rmse, spearman, n_all::BIGINT AS n FROM scored
      UNION ALL SELECT 'solution_gone', NULL, NULL, 0)"""


@query(
    "m10_formula_baselines",
    f"WITH {FORMULA_SQL} SELECT reference, round(spearman, 6) AS spearman, round(r2, 6) AS r2, n FROM formulas",
)
def formulas(spark, sf_dir):
    return rounded(formula_baselines(views.wide_items(spark, sf_dir), "target", FORMULAS))


@query(
    "m11_solution_ceilings",
    f"WITH {SOLUTION_SQL} SELECT reference, round(rmse, 6) AS rmse, round(spearman, 6) AS spearman, n FROM solutions",
)
def solutions(spark, sf_dir):
    return rounded(solution_ceilings(views.wide_items(spark, sf_dir), "target", SOLUTIONS))


@query(
    "m12_reference_bracket",
    f"""SELECT * FROM (
    SELECT 'trivial_floor' AS section, 'target' AS reference, 'rmse' AS metric, round(stddev_pop(l_extendedprice), 6) AS value, count(*)::BIGINT AS n FROM lineitem
    UNION ALL SELECT 'noise_floor', 'se', 'mean_se', round(avg(l_tax), 6), count(*) FROM lineitem
    UNION ALL SELECT 'noise_floor', 'se', 'median_se', round(median(l_tax), 6), count(*) FROM lineitem
    UNION ALL SELECT 'formula', reference, unnest(['spearman', 'r2']), unnest([round(spearman, 6), round(r2, 6)]), n FROM (WITH {FORMULA_SQL} SELECT * FROM formulas)
    UNION ALL SELECT 'ceiling', reference, unnest(['rmse', 'spearman']), unnest([round(rmse, 6), round(spearman, 6)]), n FROM (WITH {SOLUTION_SQL} SELECT * FROM solutions))""",
)
def bracket(spark, sf_dir):
    return rounded(reference_bracket(views.wide_items(spark, sf_dir), "target", "se", FORMULAS, SOLUTIONS))


BOOT = f"""{sql.SMALL}, rows_ AS (
      SELECT *, row_number() OVER (ORDER BY id) - 1 AS position, count(*) OVER () AS n FROM small WHERE p IS NOT NULL),
    draws AS (SELECT rep, {sql.number("'42'", 'rep', 'position')} % n AS position FROM rows_, range(1000) r(rep)),
    reps AS (SELECT rep, t, p FROM draws JOIN rows_ USING (position))"""


def _spearman(source: str, keys: str, pred: str = "p") -> str:
    rt, rp = sql.avg_rank("t", keys), sql.avg_rank(pred, keys)
    return f"(SELECT {keys}, corr(rt, rp) AS value FROM (SELECT {keys}, {rt} AS rt, {rp} AS rp FROM {source}) GROUP BY {keys})"


@query(
    "m13_bootstrap_spearman",
    f"""WITH {BOOT}, whole AS (SELECT 1 AS g, t, p FROM rows_)
    SELECT 'spearman' AS metric, (SELECT round(value, 6) FROM {_spearman('whole', 'g')}) AS point,
      round(quantile_cont(value, 0.025), 6) AS ci_lo, round(quantile_cont(value, 0.975), 6) AS ci_hi, 'exact' AS mode
    FROM {_spearman('reps', 'rep')}""",
)
def boot_spearman(spark, sf_dir):
    rows = views.metric_small(spark, sf_dir)
    return rounded(bootstrap_ci(rows, "id", "t", "p", "spearman", mode="exact"))


def _rmse_poisson(reps: int) -> str:
    return f"""WITH {sql.SMALL}, rows_ AS (SELECT * FROM small WHERE p IS NOT NULL),
    u AS (SELECT rep, t, p, {sql.number("'42'", 'rep', 'id')} / 4294967296.0::DOUBLE AS u FROM rows_, range({reps}) r(rep)),
    w AS (SELECT rep, t, p, len(list_filter([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
      0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.9999988747974020, 0.9999998885745217]::DOUBLE[], lambda x: x <= u)) AS w FROM u),
    s AS (SELECT rep, sqrt(sum(w * pow(t - p, 2)) / sum(w)) AS value FROM w GROUP BY rep)
    SELECT 'rmse' AS metric, (SELECT round(sqrt(avg(pow(t - p, 2))), 6) FROM rows_) AS point,
      round(quantile_cont(value, 0.025), 6) AS ci_lo, round(quantile_cont(value, 0.975), 6) AS ci_hi, 'poisson' AS mode FROM s"""


@query("m13_bootstrap_rmse_poisson", _rmse_poisson(200))
def boot_rmse(spark, sf_dir):
    rows = views.metric_small(spark, sf_dir)
    return rounded(bootstrap_ci(rows, "id", "t", "p", "rmse", n_boot=200, mode="poisson"))


@query("m13_bootstrap_rmse_poisson_default", _rmse_poisson(1000))
def boot_rmse_default(spark, sf_dir):
    rows = views.metric_small(spark, sf_dir)
    return rounded(bootstrap_ci(rows, "id", "t", "p", "rmse", mode="poisson"))


@query(
    "m14_paired_bootstrap",
    f"""WITH {sql.SMALL}, rows_ AS (
      SELECT *, t + ({sql.number("'9'", 'id')} / 4294967296.0::DOUBLE - 0.5) * 9000 AS q,
        row_number() OVER (ORDER BY id) - 1 AS position, count(*) OVER () AS n FROM small WHERE p IS NOT NULL),
    draws AS (SELECT rep, {sql.number("'42'", 'rep', 'position')} % n AS position FROM rows_, range(2000) r(rep)),
    reps AS (SELECT rep, t, p, q FROM draws JOIN rows_ USING (position)), whole AS (SELECT 1 AS g, t, p, q FROM rows_),
    d AS (SELECT a.value - b.value AS delta FROM {_spearman('reps', 'rep', 'q')} a JOIN {_spearman('reps', 'rep')} b USING (rep))
    SELECT (SELECT round(a.value - b.value, 6) FROM {_spearman('whole', 'g', 'q')} a, {_spearman('whole', 'g')} b) AS delta,
      round(quantile_cont(delta, 0.025), 6) AS ci_lo, round(quantile_cont(delta, 0.975), 6) AS ci_hi,
      round(count(*) FILTER (WHERE delta <= 0) / 2000.0, 6)::DOUBLE AS p_full_not_better, 'exact' AS mode FROM d""",
)
def paired(spark, sf_dir):
    noise = (draw_number(9, "id") / F.lit(float(DRAW_RANGE)) - 0.5) * 9000
    rows = views.metric_small(spark, sf_dir).withColumn("q", F.col("t") + noise)
    return rounded(paired_bootstrap_diff(rows, "id", "t", "q", "p", mode="exact"))


VARIANT_SCORES = f"""{sql.VARIANTS}, joined AS (SELECT variant, seed, t, pred AS p FROM vpreds JOIN held USING (id)),
    {sql.scores('joined', 'variant, seed', pairs=False)}"""


@query(
    "a1_score_variants",
    f"""WITH {VARIANT_SCORES} SELECT variant, seed, round(spearman, 6) AS spearman, round(rmse, 6) AS rmse,
    (SELECT count(t) FROM held)::BIGINT AS n FROM scored""",
)
def variant_scores(spark, sf_dir):
    return rounded(score_variants(views.holdout(spark, sf_dir), views.variant_preds(spark, sf_dir)))


@query(
    "a2_mean_prediction",
    f"WITH {sql.VARIANTS} SELECT variant, id, round(avg(pred), 6) AS pred FROM vpreds GROUP BY variant, id",
)
def mean_preds(spark, sf_dir):
    return rounded(mean_prediction(views.variant_preds(spark, sf_dir)))


@query(
    "m15_aggregate_seeds",
    f"""WITH {VARIANT_SCORES} SELECT variant, round(avg(spearman), 6) AS spearman_mean, round(stddev_samp(spearman), 6) AS spearman_std,
    round(avg(rmse), 6) AS rmse_mean, round(stddev_samp(rmse), 6) AS rmse_std, count(DISTINCT seed)::BIGINT AS seeds FROM scored GROUP BY variant""",
)
def seeds(spark, sf_dir):
    scores = score_variants(views.holdout(spark, sf_dir), views.variant_preds(spark, sf_dir))
    return rounded(aggregate_seeds(scores))


@query(
    "a3_compare_to_full",
    f"""WITH {sql.VARIANTS}, means AS (SELECT variant, id, avg(pred) AS pred FROM vpreds GROUP BY variant, id),
    rows_ AS (SELECT o.variant, t, f.pred AS a, o.pred AS b, row_number() OVER (PARTITION BY o.variant ORDER BY id) - 1 AS position,
        count(*) OVER (PARTITION BY o.variant) AS n
      FROM means o JOIN (SELECT id, pred FROM means WHERE variant = 'full') f USING (id) JOIN held USING (id) WHERE o.variant <> 'full'),
    draws AS (SELECT variant, rep, {sql.number("'42'", 'rep', 'position')} % n AS position FROM rows_, range(2000) r(rep)),
    reps AS (SELECT variant, rep, t, a, b FROM draws JOIN rows_ USING (variant, position)),
    d AS (SELECT variant, x.value - y.value AS delta FROM {_spearman('reps', 'variant, rep', 'a')} x
      JOIN {_spearman('reps', 'variant, rep', 'b')} y USING (variant, rep)),
    pt AS (SELECT variant, x.value - y.value AS delta FROM {_spearman('rows_', 'variant', 'a')} x JOIN {_spearman('rows_', 'variant', 'b')} y USING (variant))
    SELECT variant, round(any_value(pt.delta), 6) AS delta, round(quantile_cont(d.delta, 0.025), 6) AS ci_lo, round(quantile_cont(d.delta, 0.975), 6) AS ci_hi,
      round(count(*) FILTER (WHERE d.delta <= 0) / 2000.0, 6)::DOUBLE AS p_full_not_better, 'exact' AS mode,
      count(*) FILTER (WHERE d.delta <= 0) / 2000.0 < 0.05 AS significant FROM d JOIN pt USING (variant) GROUP BY variant""",
)
def against_full(spark, sf_dir):
    return rounded(
        compare_to_full(views.holdout(spark, sf_dir), views.variant_preds(spark, sf_dir), mode="exact")
    )


@query(
    "t3_pairwise_hinge_loss",
    f"""WITH {sql.SMALL}, c AS (SELECT slice, t, p / 1000 AS p FROM small WHERE p IS NOT NULL)
    SELECT slice, count(*)::DOUBLE AS pairs, round(avg(greatest(0.5 - (x.p - y.p), 0)), 6) AS loss
    FROM c x JOIN c y USING (slice) WHERE x.t > y.t GROUP BY slice""",
)
def hinge(spark, sf_dir):
    rows = views.metric_small(spark, sf_dir).withColumn("score", F.col("p") / 1000)
    return rounded(pairwise_hinge(rows, ["slice"], "t", "score", margin=0.5))
