"""How much is shuffled, staged and held by a task, where that has to follow the rows."""

import datetime as dt
import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dockflow.catalog import prediction
from dockflow.operators import anomalies, models, series
from dockflow.operators.preparation import time_folds
from dockflow.operators.quantiles import aggregate
from dockflow.operators.ranking import in_share
from dockflow.plans import publish as publishing
from dockflow.plans import training
from dockflow.session import staging
from tests.test_training import TINY, features

T0 = dt.datetime(2024, 1, 1)


def staged(folder):
    return [x.rsplit("-", 1)[0] for x in os.listdir(folder)]


def test_tasks_follow_the_rows_of_the_grid(spark, monkeypatch):
    """Two rows of each station become 100: a task holds a bounded number of them, not whatever few shuffled bytes make."""
    monkeypatch.setattr(series, "TASK_ROWS", 200, raising=False)
    rows = [(f"s{i}", T0 + dt.timedelta(hours=h), 1 + h) for i in range(60) for h in (0, 99)] + [(None, T0, 7)]
    grid = series.densify(spark.createDataFrame(rows, "station_name string, time timestamp_ntz, pickups long"), ["pickups"])
    held = [r["count"] for r in grid.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert sum(held) == 6100 and max(held) <= 1000
    assert grid.agg(F.sum("pickups")).first()[0] == 60 * 101 + 7


def test_few_outliers_are_joined_without_a_shuffle_of_the_table(spark):
    """The flags of the share are a small staged table, and the scores are those of walking the trees."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"k": range(400), "a": rng.normal(size=400), "b": rng.normal(size=400)}))
    out = anomalies.four_votes(df, "a", ["k"], ["a", "b"], share=0.5, trees=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 0
    rows = out.collect()
    assert len(rows) == 400 and {r.k for r in rows} == set(range(400)) and sum(r.lof_outlier for r in rows) > 0


def test_scores_of_a_tree_are_those_of_walking_it():
    rng = np.random.default_rng(5)
    x, nodes = rng.normal(size=(300, 3)), []
    anomalies._grow(x[:64], rng, 0, 6, nodes)
    feature, cut, after, length, depth = anomalies._table(pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "size", "depth"]))
    x[0, 1] = np.nan
    for row in x:
        at, here = 0, 0
        for _ in range(depth):
            at = after[2 * at + int(row[feature[at]] < cut[at])]
        while nodes[here][0] >= 0:
            here = nodes[here][2] if row[nodes[here][0]] < nodes[here][1] else nodes[here][3]
        assert at == here and length[at] == nodes[here][5] + anomalies._average_path(np.array([nodes[here][4]]))[0]


def test_published_tables_stage_what_they_publish(spark, monkeypatch):
    """No copy of all features is written, and the history has more buckets if it has more rows."""
    monkeypatch.setattr(prediction, "_published", {})
    monkeypatch.setattr(publishing, "BUCKET_ROWS", 100, raising=False)
    with staging(spark) as folder:
        d = prediction.Data(spark, "/root/testdata/sf0.001")
        places = prediction.published(d)
        assert "features" not in staged(folder)
        n = spark.read.parquet(places["history"]).count()
        assert spark.read.json(f"{places['history']}-about").first()["buckets"] == -(-n // 100) > 64
        assert publishing.open_buckets(spark, places["history"]).count() == n


def test_search_and_training_stage_their_rows_once(spark, tmp_path):
    rows = features(spark, 220)
    with staging(spark) as folder:
        folds = time_folds(rows.select("station_name", "time", "pickups", "hour"), 2)
        out = models.halving(folds, lambda **p: models.forest(["hour"], **p), models.grid(maxDepth=[1, 2], numTrees=[1]), ["station_name", "time"], folds=2).collect()
        assert len(out) == 2 and [x for x in staged(folder) if x.startswith("halving")] == ["halving-folds"]
    with staging(spark) as folder:
        assert {r.model for r in training.train(rows, str(tmp_path / "job"), TINY).collect()} == {"boosted_deep", "forest", "ensemble"}
        assert "training-split" not in staged(folder)


def test_votes_take_the_factors_of_all_rows(spark):
    """No row is left out of the factors: flags are those of ``local_outlier_factor`` and ``isolation_forest`` on the whole table, equal rows included."""
    rng = np.random.default_rng(8)
    x = pd.DataFrame({"k": range(600), "a": rng.normal(size=600), "b": rng.normal(size=600)})
    x.loc[500:, ["a", "b"]] = [0.5, 0.25]
    x.loc[40:60, "b"] = None
    df = spark.createDataFrame(x.replace({np.nan: None}))
    out = anomalies.four_votes(df, "a", ["k"], ["a", "b"], trees=5).toPandas().set_index("k").sort_index()
    factors = anomalies.local_outlier_factor(df, ["k"], ["a", "b"]).toPandas().set_index("k").sort_index()
    forest = anomalies.isolation_forest(df, ["k"], ["a", "b"], trees=5).toPandas().set_index("k").sort_index()
    assert len(out) == 600 and factors.lof.notna().all() and out.lof_outlier.sum() > 20
    assert (out.lof_outlier == factors.lof_outlier).all()
    assert (out.iso_outlier == forest.iso_outlier).all()


def read_staged(spark, folder, name):
    return [spark.read.parquet(f"{folder}/{x}") for x in os.listdir(folder) if x.rsplit("-", 1)[0] == name]


def test_search_assembles_rows_once_and_finds_a_rounds_rows_by_folder(spark):
    """Features are staged as one vector with the round that first trains on a row, so no fit assembles or digests rows again."""
    rows = time_folds(features(spark, 220).select("station_name", "time", "pickups", "hour", "lag_24h"), 2)
    with staging(spark) as folder:
        out = models.halving(rows, lambda **p: models.forest(["hour", "lag_24h"], **p), models.grid(maxDepth=[1, 2, 3], numTrees=[1]), ["station_name", "time"], folds=2)
        assert [(r.rounds, r.share) for r in out.orderBy("rank").collect()] == [(3, 1.0), (2, 0.5), (1, 0.25)]
        (kept,) = read_staged(spark, folder, "halving-folds")
        assert set(kept.columns) == {"fold", "since", "pickups", "features"} and kept.count() == 440
        for since, share in enumerate([0.25, 0.5, 1.0]):
            assert kept.where(F.col("since") <= since).count() == rows.where(in_share(["station_name", "time"], share)).count()


def test_training_and_forecast_assemble_rows_once(spark, tmp_path):
    with staging(spark) as folder:
        training.train(features(spark, 220), str(tmp_path / "job"), TINY)
        (scaled,) = read_staged(spark, folder, "training-scaled")
        assert scaled.columns == ["station_name", "time", "actual", "pickups", "is_train", "features"]
    saved = training.load(spark, str(tmp_path / "job"))
    rows = features(spark, 30).select("station_name", "time", *training.FEATURES)
    got = {(r.station_name, r.time, r.model): r.predicted for r in models.predictions(rows, saved.models, ["station_name", "time"]).collect()}
    want = {(r.station_name, r.time, name): r.predicted for name, model in saved.models.items() for r in model.transform(rows).collect()}
    assert got == want and len(got) == 120
    few = models.forest(["hour"], numTrees=2, maxDepth=2).fit(features(spark, 30))
    mixed = models.predictions(rows, {**saved.models, "few": few}, ["station_name", "time"]).where("model = 'few'").collect()
    assert {(r.station_name, r.time): r.predicted for r in mixed} == {(r.station_name, r.time): r.predicted for r in few.transform(rows).collect()}


def test_many_aggregates_are_taken_a_few_at_a_time(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else float(-i)) for i in range(9)], "a double, b double")
    aggs = [F.sum("a").alias("s"), F.count("b").alias("n"), F.max("b").alias("m"), F.avg("a").alias("v"), F.min("b").alias("l")]
    assert aggregate(df, aggs, 2).first().asDict() == df.agg(*aggs).first().asDict()
    assert aggregate(df.limit(0), aggs, 2).first()["n"] == 0
