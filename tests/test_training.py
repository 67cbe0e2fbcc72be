"""The training job from features to a forecast by loaded artefacts."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from dockflow.catalog import load, prediction
from dockflow.operators import models
from dockflow.operators.anomalies import four_votes
from dockflow.operators.preparation import time_folds
from dockflow.plans import training
from dockflow.plans.forecast import forecast_models
from dockflow.schemas import FEATURES

TINY = training.Sizes(boosted={"boosted_deep": {"maxDepth": 2}}, rounds=2, forest={"numTrees": 3, "maxDepth": 3}, isolation_trees=10, lof_share=0.5)


def features(spark, hours=420):
    """Two stations with a daily pattern; all features given, the calendar's as numbers."""
    base = spark.range(2 * hours).select(F.concat(F.lit("s"), F.col("id") % 2).alias("station_name"), F.floor(F.col("id") / 2).alias("h"))
    time = F.timestamp_seconds(F.col("h") * 3600 + 1704067200).cast("timestamp_ntz")
    demand = 5 + 4 * F.sin(F.col("h") % 24 / 24 * 6.283) + F.when(F.col("h") == 300, 500).otherwise(0)
    rows = base.select("station_name", time.alias("time"), F.round(demand).alias("pickups"), F.lit(0).alias("dropoffs"), F.lit(0).alias("net_demand"), "h")
    others = {c: (F.lit(0.0) + (F.col("h") * (i + 3)) % (7 + i)) for i, c in enumerate(FEATURES)}
    return rows.withColumns({**others, "hour": (F.col("h") % 24).cast("double"), "lag_24h": F.round(5 + 4 * F.sin(F.col("h") % 24 / 24 * 6.283)), "temp": F.when(F.col("h") % 50 > 0, F.col("h") % 9).cast("double")}).drop("h")


def test_artefacts(spark, tmp_path):
    root, rows = str(tmp_path / "job"), features(spark)
    metrics = {r.model: r for r in training.train(rows, root, TINY).collect()}
    assert set(metrics) == {"boosted_deep", "forest", "ensemble"} and metrics["ensemble"].n == metrics["forest"].n
    saved = training.load(spark, root)
    weights = {r.model: r.weight for r in saved.weights.collect()}
    assert abs(sum(weights.values()) - 1) < 1e-9 and set(saved.models) == set(weights) and saved.features == FEATURES
    clean = training.prepared(rows, TINY)
    assert clean.where("pickups > 100").count() == 0 and clean.where("temp is null").count() == 0 and clean.where("is_train = 0").count() > 0
    asked = spark.createDataFrame([("s0",), ("s1",)], "station_name string").select("station_name", F.lit("2024-01-15 00:00:00").cast("timestamp_ntz").alias("start"), F.lit("2024-01-15 06:00:00").cast("timestamp_ntz").alias("end"))
    history = rows.select("station_name", "time", "pickups", "dropoffs", "net_demand", "temp", "prcp", "wspd")
    out = forecast_models(asked, history, saved.models, saved.weights, saved.scaler_x, saved.scaler_y).collect()
    assert len(out) == 12 and all(0 <= r.predicted < 100 for r in out)
    about = json.loads(spark.read.text(f"{root}/manifest").first()[0])
    spark.range(1).select(F.lit(json.dumps({**about, "features": FEATURES[::-1]})).alias("value")).write.mode("overwrite").text(f"{root}/manifest")
    with pytest.raises(ValueError, match="other order"):
        training.load(spark, root)


def test_votes_are_those_of_four_flags(spark):
    got = load()[0]["outlier_votes"](spark, "/root/testdata/sf0.001").drop("time").toPandas()
    flags = ["iqr_outlier", "z_outlier", "iso_outlier", "lof_outlier"]
    con = duckdb.connect()
    con.register("got", got)
    bad = con.execute(f"select count(*) from got where is_outlier <> ({' + '.join(flags)} >= 2)::int").fetchall()[0][0]
    assert bad == 0 and (got[flags].sum() > 0).all()


def test_halving_finds_the_known_best(spark):
    rows = time_folds(features(spark).select("station_name", "time", "pickups", "hour"), 3)
    candidates = models.grid(maxDepth=[1, 6], numTrees=[1, 2, 3, 4])
    out = models.halving(rows, lambda **p: models.forest(["hour"], **p), candidates, ["station_name", "time"], first=0.25).collect()
    assert [r.rank for r in out] == list(range(1, 9)) and json.loads(out[0].params)["maxDepth"] == 6 and out[0].share == 1.0
    assert sorted(r.rounds for r in out) == [1, 1, 1, 1, 2, 2, 3, 3]


def test_full_forest(spark, tmp_path):
    """The forest of the full job, 300 trees of depth 20, on a small table."""
    rows = features(spark, 100)
    model = models.forest(["hour", "lag_24h"]).fit(rows)
    assert model.stages[-1].getNumTrees == 300 and model.stages[-1].getMaxDepth() == 20


def test_outliers_of_the_job_are_voted_on_all_rows(spark):
    """By default the job removes what the four methods find on the whole table, the factor among all rows included."""
    rows, wanted = features(spark), training.Sizes(isolation_trees=10, votes=1)
    flags = four_votes(training.training_rows(rows).select("station_name", "time", F.col("pickups").cast("double").alias("pickups"), *training.VOTED[1:]),
                       "pickups", training.KEY, training.VOTED, least=1, trees=10)
    odd = flags.where("is_outlier = 1").count()
    assert flags.where("lof_outlier = 1").count() > 0.03 * flags.count()
    assert training.prepared(rows, wanted).count() == flags.count() - odd and training.Sizes().lof_share == prediction.TRIAL.lof_share == 1.0
