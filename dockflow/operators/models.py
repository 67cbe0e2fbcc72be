"""Demand models on Spark ML trees: training, parameter search over time folds, importances."""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.operators.evaluation import metrics
from dockflow.operators.ranking import in_share
from dockflow.schemas import CALENDAR_FEATURES, WEATHER_FEATURES
from dockflow.session import stage

# Three boosted parameter sets and the forest (trees, depth) used for the ensemble.
BOOSTED = {
    "boosted_deep": {"maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8},
    "boosted_even": {"maxDepth": 5, "stepSize": 0.1, "subsamplingRate": 1.0},
    "boosted_slow": {"maxDepth": 4, "stepSize": 0.05, "subsamplingRate": 0.8},
}
FOREST = {"numTrees": 300, "maxDepth": 20}


def assemble(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)


def boosted(features: list[str], label: str = "pickups", rounds: int = 100, seed: int = 42, **params) -> Pipeline:
    tree = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="predicted", maxIter=rounds, seed=seed, **params)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), tree])


def forest(features: list[str], label: str = "pickups", seed: int = 42, **params) -> Pipeline:
    tree = RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol="predicted", seed=seed,
                                 featureSubsetStrategy="sqrt", **{**FOREST, **params})
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), tree])


def predictions(df: DataFrame, models: dict[str, PipelineModel], keep: list[str]) -> DataFrame:
    """(keep, model, predicted): every model's prediction of every row, in one pass over the rows.

    Models are an assembler and a tree model. Features are assembled once for all models that have the same, or not at all if ``df`` has their vector.
    """
    vectors: dict[tuple[str, ...], str] = {}
    out = df
    for i, model in enumerate(models.values()):
        assembler, tree = model.stages
        inputs = tuple(assembler.getInputCols())
        if inputs not in vectors:
            vectors[inputs] = "features" if "features" in df.columns else f"_v{len(vectors)}"
            if vectors[inputs] not in df.columns:
                out = assembler.transform(out, {assembler.outputCol: vectors[inputs]})
        out = tree.transform(out, {tree.featuresCol: vectors[inputs], tree.predictionCol: f"_p{i}"})
    each = F.array(*[F.struct(F.lit(name).alias("model"), F.col(f"_p{i}").alias("predicted")) for i, name in enumerate(models)])
    return out.select(*keep, F.explode(each).alias("_m")).select(*keep, "_m.*")


def grid(**values) -> list[dict]:
    """All combinations of the listed parameter values."""
    return [dict(zip(values, combo)) for combo in product(*values.values())]


def halving(df: DataFrame, build, candidates: list[dict], key: list[str], folds: int = 3, label: str = "pickups", first: float = 0.25, keep: float = 0.5, at_once: int = 4) -> DataFrame:
    """Successive halving over expanding time folds (column ``fold``): (rank, params, rounds, share, mae), best first.

    Every candidate is fitted on a ``first`` share of each fold's training rows, chosen by a digest of their key, and tested on all rows of
    the fold. The better part of them goes on to a round with as much more data, until the last ones have seen all of it. Candidates of a
    round are fitted at the same time, ``at_once`` of them. ``build`` makes a pipeline of an assembler, the same for all, and an estimator. The
    rows are assembled, unless they have their ``features``, and staged once, by fold and by the first round (``since``) that trains on them: those of a fit are found by their folders.
    """
    shares = [min(1.0, first)]
    while shares[-1] < 1.0:
        shares.append(min(1.0, shares[-1] / keep))
    since = sum((F.when(in_share(key, s), 0).otherwise(1) for s in shares[1:]), F.when(in_share(key, shares[0]), 0).otherwise(1))
    rows = df if "features" in df.columns else build(**candidates[0]).getStages()[0].transform(df)
    rows = rows.select("fold", since.alias("since"), F.col(label).cast("double").alias(label), "features")
    kept = stage(rows, "halving-folds", ["fold", "since"])
    parts = [(kept.where(F.col("fold") < i), kept.where(F.col("fold") == i)) for i in range(1, folds + 1)]

    def error(params: dict, share: float) -> float:
        found = []
        for train, test in parts:
            model = build(**params).getStages()[-1].fit(train.where(F.col("since") <= shares.index(share)))
            found.append(metrics(model.transform(test).select(F.col(label).alias("actual"), "predicted")).first()["mae"])
        return sum(found) / len(found)

    left, done = list(range(len(candidates))), {}
    for rounds, share in enumerate(shares, 1):
        with ThreadPoolExecutor(at_once) as pool:
            errors = dict(zip(left, pool.map(lambda i, share=share: error(candidates[i], share), left)))
        done |= {i: (rounds, share, e) for i, e in errors.items()}
        left = sorted(left, key=lambda i: (errors[i], i))[:max(1, math.ceil(len(left) * keep))]
    order = sorted(done, key=lambda i: (-done[i][0], done[i][2], i))
    rows = [(r + 1, json.dumps(candidates[i], sort_keys=True), *done[i]) for r, i in enumerate(order)]
    return df.sparkSession.createDataFrame(rows, "rank int, params string, rounds int, share double, mae double")


def feature_category(name: str) -> str:
    if name in WEATHER_FEATURES:
        return "weather"
    return "temporal" if name in CALENDAR_FEATURES else "lag"


def importances(df: DataFrame, model, features: list[str]) -> DataFrame:
    """Feature importances of a fitted tree model with their category and rank; one row per feature."""
    values = model.stages[-1].featureImportances.toArray()
    rows = sorted(((n, feature_category(n), float(v)) for n, v in zip(features, values)), key=lambda r: (-r[2], r[0]))
    return df.sparkSession.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "rank int, feature string, category string, importance double")


def importance_by_category(table: DataFrame) -> DataFrame:
    return table.groupBy("category").agg(F.sum("importance").alias("importance"), F.count(F.lit(1)).alias("n_features"))
