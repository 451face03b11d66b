"""The data side of training: row views, stages, losses, scoring, and a Spark ML teacher ensemble."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, VectorAssembler
from pyspark.ml.functions import predict_batch_udf
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, functions as F

from textgrade.functions.draws import DRAW_RANGE, draw_number
from textgrade.functions.numbers import as_number, clip
from textgrade.functions.text import BLANKS, difficulty_proxy
from textgrade.operators.bootstrap import poisson_count
from textgrade.operators.ranks import SPACING, unique_rank
from textgrade.operators.sampling import BROADCAST_IDS
from textgrade.sources.settled import settle


def source_map(train: DataFrame, spacing: int = SPACING) -> DataFrame:
    """``(corpus, source)``: corpora of the training rows in order of name, numbered from 0."""
    names = train.where(F.col("corpus").isNotNull()).select("corpus").distinct()
    ranked = unique_rank(names, ["corpus"], spacing=spacing)
    return ranked.select("corpus", (F.col("rank") - 1).alias("source"), F.col("rows").alias("sources"))


def training_view(
    df: DataFrame,
    target_col: str,
    sources: DataFrame,
    confidence_weighting: bool = True,
) -> DataFrame:
    """``(id, text, target, source, weight)``.

    Corpora the training rows do not have get the slot after the last one. Weight is the mapping
    confidence inside [0, 1], 1 where it is missing or not used.
    """
    if confidence_weighting and "mapping_confidence" in df.columns:
        weight = clip(F.coalesce(as_number(F.col("mapping_confidence")), F.lit(1.0)), 0.0, 1.0)
    else:
        weight = F.lit(1.0)
    sources = settle(sources.select("corpus", "source"))
    known = sources.count()
    unseen = F.lit(known)
    # One narrow row per corpus: sent to the tasks while counted to be few, so that texts stay where they are.
    right = F.broadcast(sources) if known <= BROADCAST_IDS else sources
    return df.join(right, "corpus", "left").select(
        "id",
        "text",
        as_number(F.col(target_col)).alias("target"),
        F.coalesce("source", unseen).cast("long").alias("source"),
        weight.alias("weight"),
    )


def training_stages(df: DataFrame, two_stage: bool = True) -> DataFrame:
    """Rows that take part in training, with ``stage`` and ``role``.

    Two stages: pseudo rows are stage A, gold train and val rows stage B. Without pseudo rows, or
    with ``two_stage`` off, there is one stage ``single`` over the train and val rows.
    """
    pseudo = F.coalesce(F.col("is_pseudo"), F.lit(False))
    if two_stage:
        staged = F.coalesce(df.agg(F.bool_or(pseudo).alias("x")).scalar(), F.lit(False))
    else:
        staged = F.lit(False)
    in_pool = F.col("split").isin("train", "val")
    stage = (
        F.when(staged & pseudo, "A").when(staged & in_pool, "B").when(~staged & in_pool, "single")
    )
    return (
        df.withColumn("stage", stage)
        .where("stage is not null")
        .withColumn("role", F.when(F.col("stage") == "A", "train").otherwise(F.col("split")))
    )


def pointwise_loss(
    df: DataFrame, batch: list[str], target: str, pred: str, weight: str
) -> DataFrame:
    """Mean of weight x squared error per batch (divided by the row count, not the weights)."""
    gap = F.col(pred) - F.col(target)
    return df.groupBy(*batch).agg(F.avg(F.col(weight) * gap * gap).alias("loss"))


def best_epoch(history: DataFrame, run: list[str]) -> DataFrame:
    """Per run, the first epoch with the smallest validation error; later ties do not replace it."""
    rmse = as_number(F.col("val_rmse"))
    seen = history.where(rmse.isNotNull())
    best = F.min(F.struct(rmse.alias("val_rmse"), F.col("epoch"))).alias("b")
    return seen.groupBy(*run).agg(best).select(*run, "b.epoch", "b.val_rmse")


def score_rows(
    df: DataFrame,
    make_model: Callable,
    text_col: str = "text",
    out_col: str = "pred",
    return_type: str = "double",
    batch_size: int = 256,
) -> DataFrame:
    """``(id, <out_col>)`` from a user model over a text column, in batches on the executors.

    ``make_model`` is called once per worker and returns a function from an array of texts to an
    array of numbers, or of vectors when ``return_type`` is an array.
    """
    model = predict_batch_udf(make_model, return_type=_spark_type(return_type), batch_size=batch_size)
    return df.select(F.col("id").cast("string").alias("id"), model(F.col(text_col)).alias(out_col))


def _spark_type(name: str):
    from pyspark.sql.types import ArrayType, DoubleType, FloatType

    return {
        "double": DoubleType(),
        "array<float>": ArrayType(FloatType()),
        "array<double>": ArrayType(DoubleType()),
    }[name]


# Weight of the squared coefficients, and how many rows without error an offset is shrunk by.
RIDGE = 0.1
OFFSET_ROWS = 10.0


@dataclass(frozen=True)
class Teachers:
    """How features are made, a model per seed, and offsets ``(corpus, teacher, offset)`` or None."""

    prepared: PipelineModel
    models: dict[int, LinearRegressionModel]
    offsets: DataFrame | None


def fit_teachers(
    train: DataFrame,
    target_col: str = "native_label",
    n_teachers: int = 3,
    first_seed: int = 42,
    features: int = 1024,
    source_offset: bool = True,
) -> Teachers:
    """An ensemble of ridge models of texts, each on its own md5-drawn resample of the rows.

    Features are ``features`` hashed word weights (none, if 0) and the readability proxy. What a model misses on
    average in a corpus, shrunk as if ``OFFSET_ROWS`` further rows missed nothing, is the offset of that corpus; a
    corpus not seen in training has offset zero.
    """
    rows = _text_features(train).withColumn("target", as_number(F.col(target_col)))
    rows = rows.where("target is not null")
    words = [
        HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
        IDF(inputCol="counts", outputCol="terms"),
    ] if features else []
    inputs = ["terms", "proxy"] if features else ["proxy"]
    prepared = Pipeline(stages=[*words, VectorAssembler(inputCols=inputs, outputCol="features")]).fit(rows)
    # Every teacher reads the features once: few columns, so the normal equations take one pass.
    ready = settle(prepared.transform(rows).select("id", "corpus", "features", "target"), spread_by="id")
    models, misses = {}, []
    for seed in range(first_seed, first_seed + n_teachers):
        uniform = ready.withColumn("_u", draw_number(seed, "id") / F.lit(DRAW_RANGE))
        drawn = uniform.withColumn("weight", poisson_count(F.col("_u")).cast("double")).where("weight > 0").drop("_u")
        models[seed] = LinearRegression(
            labelCol="target", weightCol="weight", regParam=RIDGE, standardization=False, solver="normal"
        ).fit(drawn)
        missed = F.sum(F.col("weight") * (F.col("target") - F.col("prediction")))
        misses.append(
            models[seed].transform(drawn).groupBy("corpus").agg((missed / (F.sum("weight") + OFFSET_ROWS)).alias("offset"))
            .withColumn("teacher", F.lit(seed))
        )
    offsets = settle(reduce(DataFrame.unionByName, misses)) if source_offset else None
    return Teachers(prepared, models, offsets)


def _text_features(df: DataFrame) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), BLANKS), lambda w: w != "")
    return df.withColumns(
        {"words": words, "proxy": difficulty_proxy("text"), "corpus": F.coalesce("corpus", F.lit(""))}
    )


def predict_teachers(teachers: Teachers, df: DataFrame) -> DataFrame:
    """One long table ``(id, teacher, pred)`` from all teachers, with the features made once."""
    ready = teachers.prepared.transform(_text_features(df)).select("id", "corpus", "features")
    scored = reduce(
        lambda d, seed: teachers.models[seed].setPredictionCol(f"p{seed}").transform(d), teachers.models, ready
    )
    items = [
        F.struct(F.lit(seed).alias("teacher"), F.col(f"p{seed}").alias("pred")) for seed in teachers.models
    ]
    long = scored.select("id", "corpus", F.explode(F.array(*items)).alias("t")).select("id", "corpus", "t.*")
    if teachers.offsets is None:
        return long.drop("corpus")
    few = teachers.offsets.count() <= BROADCAST_IDS
    moved = long.join(F.broadcast(teachers.offsets) if few else teachers.offsets, ["corpus", "teacher"], "left")
    return moved.select("id", "teacher", (F.col("pred") + F.coalesce("offset", F.lit(0.0))).alias("pred"))
