"""The training job: vote, removal, split, scaling, models, weights and metrics, saved so that a forecast only loads them."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.operators.anomalies import four_votes, remove_outliers
from dockflow.operators.evaluation import metrics
from dockflow.operators.forecasting import inverse_mae_weights
from dockflow.operators.models import BOOSTED, FOREST, assemble, boosted, forest, predictions
from dockflow.operators.preparation import apply_standard, fit_standard, time_split
from dockflow.operators.quantiles import aggregate, fill_median
from dockflow.plans.feature_table import training_rows
from dockflow.schemas import FEATURES
from dockflow.session import stage

KEY, LABEL = ["station_name", "time"], "pickups"
VOTED = [LABEL, "temp", "prcp", "roll_mean_24h", "lag_24h"]


@dataclass
class Sizes:
    """Sizes of the models. The defaults are those of the full job; smaller ones are for a trial of the whole way."""

    boosted: dict[str, dict] | None = None
    rounds: int = 600
    forest: dict | None = None
    isolation_trees: int = 100
    lof_share: float = 1.0  # of the rows that the outlier factors score
    votes: int = 2  # methods that must agree on an outlier


def prepared(features: DataFrame, sizes: Sizes) -> DataFrame:
    """Rows with a week of history and without outliers, marked as training or test rows by time.

    Missing values become the median of the column over all rows that are left, as far as there are any.
    """
    rows = stage(training_rows(features).select(*KEY, F.col(LABEL).cast("double").alias(LABEL), *[F.col(c).cast("double").alias(c) for c in FEATURES]), "training-rows")
    clean = stage(remove_outliers(four_votes(rows, LABEL, KEY, VOTED, sizes.lof_share, sizes.votes, sizes.isolation_trees)).select(*rows.columns), "training-clean")
    gaps = aggregate(clean, [F.count_if(F.col(c).isNull()).alias(c) for c in FEATURES]).first().asDict()
    return time_split(fill_median(clean, [c for c, n in gaps.items() if n]) if any(gaps.values()) else clean)


def train(features: DataFrame, root: str, sizes: Sizes | None = None) -> DataFrame:
    """Run the job and save under ``root``: a pipeline for each model, scalers of features and target, weights, metrics, and a manifest,
    written last, without which nothing loads. Returns the metrics of models and ensemble on the last fifth in time.

    Scalers are fitted on the training rows only; errors are measured in trips. Features are assembled once, for all models.
    """
    sizes = sizes or Sizes()
    rows = prepared(features, sizes)
    learn = rows.where("is_train = 1")
    scaler_x, scaler_y = (stage(fit_standard(learn, c), "training-scaler") for c in (FEATURES, [LABEL]))
    scaled = apply_standard(rows.withColumn("actual", F.col(LABEL)), [*FEATURES], scaler_x)
    scaled = assemble(apply_standard(scaled, [LABEL], scaler_y), FEATURES).select(*KEY, "actual", LABEL, "is_train", "features")
    scaled = stage(scaled, "training-scaled")
    pipes = {name: boosted(FEATURES, LABEL, sizes.rounds, **p) for name, p in (sizes.boosted or BOOSTED).items()} | {"forest": forest(FEATURES, LABEL, **(sizes.forest or FOREST))}
    y, fitted = scaler_y.first(), {}
    for name, pipe in pipes.items():
        assembler, tree = pipe.getStages()
        fitted[name] = PipelineModel([assembler, tree.fit(scaled.where("is_train = 1"))])
        fitted[name].write().overwrite().save(f"{root}/models/{name}")
    back = F.greatest(F.lit(0.0), F.col("predicted") * y[f"{LABEL}_scale"] + y[f"{LABEL}_mean"])
    votes = stage(predictions(scaled.where("is_train = 0"), fitted, [*KEY, "actual"]).withColumn("predicted", back), "training-votes")
    errors = metrics(votes, ["model"])
    weights = stage(inverse_mae_weights(errors), "training-weights")
    total = F.sum(F.col("weight") * F.col("predicted")) / F.sum("weight")
    whole = votes.join(F.broadcast(weights.select("model", "weight")), "model").groupBy(*KEY).agg(F.first("actual").alias("actual"), total.alias("predicted"))
    out = stage(errors.unionByName(metrics(whole.withColumn("model", F.lit("ensemble")), ["model"])), "training-metrics")
    for name, table in {"scaler_x": scaler_x, "scaler_y": scaler_y, "weights": weights, "metrics": out}.items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")
    about = json.dumps({"models": list(pipes), "features": FEATURES, "label": LABEL, "rows": scaled.count()})
    rows.sparkSession.range(1).select(F.lit(about).alias("value")).write.mode("overwrite").text(f"{root}/manifest")
    return out


@dataclass
class Artefacts:
    """What a forecast needs, as saved."""

    models: dict[str, PipelineModel]
    weights: DataFrame
    scaler_x: DataFrame
    scaler_y: DataFrame
    features: list[str]


def load(spark: SparkSession, root: str) -> Artefacts:
    """The saved job; fails if the features that it was trained on aren't those of this library, in their order."""
    about = json.loads(spark.read.text(f"{root}/manifest").first()["value"])
    if about["features"] != FEATURES:
        raise ValueError(f"saved features differ: {sorted(set(about['features']) ^ set(FEATURES)) or 'other order'}")
    table = lambda name: spark.read.parquet(f"{root}/{name}")
    return Artefacts({m: PipelineModel.load(f"{root}/models/{m}") for m in about["models"]}, table("weights"), table("scaler_x"), table("scaler_y"), about["features"])
