"""Direction signal: features, training, calibrated scoring, output gate."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from . import blocks

FEATURES = ("sentiment_score", "sentiment_confidence", "price_delta_24h", "volume_delta")
REQUIRED = ("avg_sentiment_score", "avg_positive_prob", "avg_negative_prob", "avg_neutral_prob", "price_delta_24h", "volume_delta")
SCHEMA_VERSION = 1


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def prepare(df: DataFrame, require_label: bool = False) -> DataFrame:
    missing = [c for c in (*REQUIRED, *(["label"] if require_label else [])) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    best = F.greatest(*[F.nanvl(F.col(f"avg_{k}_prob"), F.lit(None).cast("double")) for k in ("positive", "negative", "neutral")])
    return df.withColumns({"sentiment_score": F.col("avg_sentiment_score"), "sentiment_confidence": best})


def training_data(spark: SparkSession, size: int = 500, seed: int = 42) -> DataFrame:
    """Synthetic rows: uniform draws in the order positive, negative, price, volume; label by the sign of delta plus 0.3 sentiment."""
    rng = np.random.RandomState(seed)
    # fixed values: the ranges of the draws
    positive, negative = rng.uniform(0.2, 0.9, size), rng.uniform(0.0, 0.6, size)
    delta, volume = rng.uniform(-0.05, 0.05, size), rng.uniform(-0.3, 0.3, size)
    score = positive - negative
    columns = [range(size), score, positive, negative, np.clip(1.0 - positive - negative, 0.0, 1.0), delta, volume, (delta + 0.3 * score > 0).astype(int)]
    rows = [tuple(x.item() if hasattr(x, "item") else x for x in r) for r in zip(*columns)]
    return spark.createDataFrame(rows, "row int, " + ", ".join(f"{c} double" for c in REQUIRED) + ", label int")


def split(df: DataFrame, order: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The first ``share`` of rows by ``order`` and the rest, by places from one distributed sort."""
    ranked = blocks.numbered(df, [], [order], "__r").checkpoint()
    cut = int(ranked.count() * share)
    return ranked.where(F.col("__r") < cut).drop("__r"), ranked.where(F.col("__r") >= cut).drop("__r")


def train(spark: SparkSession, data: DataFrame, order: str = "row", trees: int = 100, seed: int = 42) -> tuple[dict[str, PipelineModel], dict[str, float]]:
    """Logistic regression and forest on population-scaled features of the first 80 %; metrics on the rest."""
    first, rest = split(prepare(data, True), order)
    stats = first.agg(*[f(c).alias(f"{k}_{c}") for c in FEATURES for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    n = first.count()

    def scaled(df: DataFrame) -> DataFrame:
        return df.withColumns({f"z_{c}": (F.col(c) - (stats[f"m_{c}"] or 0.0)) / (stats[f"s_{c}"] or 1.0) for c in FEATURES})

    gather = VectorAssembler(inputCols=[f"z_{c}" for c in FEATURES], outputCol="features")
    kinds = {
        "lr": LogisticRegression(maxIter=1000, regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False, labelCol="label"),
        "rf": RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=12, labelCol="label"),
    }
    models, metrics = {}, {}
    for name, stage in kinds.items():
        models[name] = Pipeline(stages=[gather, stage]).fit(scaled(first))
        models[name].scale = stats.asDict()
        out = models[name].transform(scaled(rest))
        metrics[f"{name}_accuracy"] = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(out)
        metrics[f"{name}_f1"] = MulticlassClassificationEvaluator(metricName="fMeasureByLabel", metricLabel=1.0).evaluate(out)
        metrics[f"{name}_auc"] = BinaryClassificationEvaluator(numBins=0).evaluate(out)
    return models, metrics


def probability(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Adds ``probability_up`` from a trained model; needs :func:`prepare`'s columns."""
    s = model.scale
    scaled = df.withColumns({f"z_{c}": (F.col(c) - (s[f"m_{c}"] or 0.0)) / (s[f"s_{c}"] or 1.0) for c in FEATURES})
    out = model.transform(scaled).withColumn("probability_up", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction", *[f"z_{c}" for c in FEATURES])


def save(models: dict[str, PipelineModel], metrics: dict[str, float], path: str) -> None:
    spark = SparkSession.getActiveSession()
    for name, m in models.items():
        m.write().overwrite().save(f"{path}/{name}")
    about = {"schema_version": SCHEMA_VERSION, "metrics": metrics, "scale": {k: m.scale for k, m in models.items()}, "real_training_data": False}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[dict[str, PipelineModel], dict[str, float]]:
    about = json.loads(spark.read.text(f"{path}/about").first()[0])
    missing = {"schema_version", "metrics", "scale"} - set(about)
    if missing or about["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"not a model of version {SCHEMA_VERSION}: {sorted(missing)}")
    models = {k: PipelineModel.load(f"{path}/{k}") for k in about["scale"]}
    for k, m in models.items():
        m.scale = about["scale"][k]
    return models, about["metrics"]


def four(c: Column) -> Column:
    """Four places; a tie of decimals goes up, whatever its double is."""
    return F.round(c + 1e-10, 4)


def calibrated_probability(p: Column, score: Column, delta: Column) -> Column:
    """Sixty parts model, forty parts a sigmoid of sentiment and price, clipped twice."""
    prior = 1 / (1 + F.exp(-fixed.PRIOR_SLOPE * (fixed.PRIOR_SENTIMENT * score + fixed.PRIOR_PRICE * delta)))
    return four(clip(fixed.MODEL_SHARE * clip(p, *fixed.PROBABILITY_RANGE) + fixed.PRIOR_SHARE * prior, *fixed.PROBABILITY_RANGE))


def calibrated_confidence(p: Column, score: Column, delta: Column, volume: Column) -> Column:
    sides = ((delta, fixed.CONFIDENCE_PRICE), (score, fixed.CONFIDENCE_SENTIMENT), (volume, fixed.CONFIDENCE_VOLUME))
    extra = sum((F.least(F.abs(c) * weight, F.lit(most)) for c, (weight, most) in sides), F.lit(0.0))
    return four(clip(F.greatest(p, 1 - p) + extra, *fixed.CONFIDENCE_RANGE))


def calibrate(df: DataFrame, sentiment_in_row: bool = False) -> DataFrame:
    """Movement from ``probability_up``. A row built from aggregates carries no own sentiment, which then counts as zero."""
    s = F.col("sentiment_score") if sentiment_in_row else F.lit(0.0)
    p = calibrated_probability(F.col("probability_up"), s, F.col("price_delta_24h"))
    df = df.withColumn("calibrated", p)
    return df.withColumns({
        "confidence": calibrated_confidence(F.col("calibrated"), s, F.col("price_delta_24h"), F.col("volume_delta")),
        "movement": F.when(F.col("calibrated") > fixed.UP, "up").when(F.col("calibrated") < fixed.DOWN, "down").otherwise("neutral"),
    })


def request_row(df: DataFrame) -> DataFrame:
    """Model input from a request: clipped deltas and class means made from score and confidence."""
    s, c = F.col("sentiment_score"), F.col("sentiment_confidence")
    return df.withColumns({
        "price_delta_24h": clip(F.col("price_delta_24h"), -fixed.REQUEST_PRICE, fixed.REQUEST_PRICE), "volume_delta": clip(F.col("volume_delta"), -fixed.REQUEST_VOLUME, fixed.REQUEST_VOLUME),
        "avg_sentiment_score": s,
        "avg_positive_prob": four(c * F.greatest(F.lit(0.0), 0.5 + s / 2)),
        "avg_negative_prob": four(c * F.greatest(F.lit(0.0), 0.5 - s / 2)),
        "avg_neutral_prob": four(F.greatest(F.lit(0.0), 1 - c)),
    })


def batch(df: DataFrame, model: PipelineModel) -> DataFrame:
    """Uncalibrated: up or down, with the probability of that class."""
    out = probability(prepare(df), model)
    up = F.col("probability_up") > 0.5
    return out.withColumns({"movement": F.when(up, "up").otherwise("down"), "confidence": F.when(up, F.col("probability_up")).otherwise(1 - F.col("probability_up"))})


def gate(ticker: Column, has_market: Column, has_sentiment: Column, real_training: Column) -> Column:
    """What becomes of a prediction request."""
    return (
        F.when(~F.coalesce(ticker.rlike("^[A-Z]{1,5}$"), F.lit(False)) | ~has_market, "not_found")
        .when(~has_sentiment, "no_sentiment")
        .when(~real_training, "withheld")
        .otherwise("ready")
    )


def provenance(metrics: dict[str, float], model: str) -> dict[str, float]:
    return {k: v for k, v in metrics.items() if k.startswith(model)}
