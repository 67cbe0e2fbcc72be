"""Nearest rows, local outlier factors and exact quantiles against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dockflow.operators import anomalies, nearest, quantiles, spatial


def brute_lof(x, k):
    """The factor with ties, by all distances."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    other = ~np.eye(len(x), dtype=bool)
    reach = np.array([np.sort(d[i][other[i]])[k - 1] for i in range(len(x))])
    near = [np.flatnonzero(other[i] & (d[i] <= reach[i])) for i in range(len(x))]
    dense = np.array([1 / (np.maximum(d[i][n], reach[n]).mean() + 1e-10) for i, n in enumerate(near)])
    return np.array([dense[n].mean() / dense[i] for i, n in enumerate(near)])


def test_factors_by_force(spark):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.integers(0, 6, (260, 3)), rng.normal(20, 5, (60, 3)).round(2), [[500.0, 0, 0], [500.0, 1, 0]], np.full((30, 3), 3.0)]).astype(float)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    got = {r.id: r for r in anomalies.local_outlier_factor(df, ["id"], ["a", "b", "c"], k=10, share=1).collect()}
    want = brute_lof(x, 10)
    assert np.allclose([got[i].lof for i in range(len(x))], want, rtol=1e-6)
    edge = np.quantile(np.round(want, 9), 0.95)
    assert [got[i].lof_outlier for i in range(len(x))] == [int(w > edge) for w in np.round(want, 9)]


def test_factors_of_a_share_and_few_rows(spark):
    df = spark.range(4000).select("id", (F.col("id") % 37).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 11).cast("double").alias("b"))
    got = anomalies.local_outlier_factor(df, ["id"], ["a", "b"], k=5, share=0.05)
    n = got.agg(F.count("*").alias("n"), F.count("lof").alias("f"), F.sum("lof_outlier").alias("o")).first()
    assert n.n == 4000 and 130 < n.f < 270 and n.o <= 0.05 * n.f + 1
    one = anomalies.local_outlier_factor(df.limit(1), ["id"], ["a", "b"], share=1).collect()
    assert [(r.lof, r.lof_outlier) for r in one] == [(None, 0)]


@pytest.mark.parametrize("leaf", [4, 64])
def test_nearest_station_by_force(spark, leaf):
    rng = np.random.default_rng(1)
    st = np.vstack([rng.normal([-74, 40.7], 0.01, (400, 2)), rng.uniform(-60, 60, (20, 2)), [[0.0, 0.0]]]).round(4)
    pt = np.vstack([rng.normal([-74, 40.7], 0.02, (300, 2)), rng.uniform(-90, 90, (50, 2)), [[0.0, 0.0], [-74, 40.7]], st[:20]])
    stations = spark.createDataFrame([(f"s{i:03d}", float(a[1]), float(a[0])) for i, a in enumerate(st)] + [("null", None, 1.0)], "station_name string, lat double, lon double")
    points = spark.createDataFrame([(i, float(a[1]), float(a[0])) for i, a in enumerate(pt)] + [(9000, None, 1.0)], "point_id long, lat double, lon double")
    got = {r.point_id: r for r in spatial.nearest_station(points, stations, leaf).collect()}
    d = np.sqrt(((pt[:, None] - st[None]) ** 2).sum(axis=2))
    assert len(got) == len(pt) + 1 and got[9000].station_name is None
    for i in range(len(pt)):
        assert np.isclose(got[i].dist, d[i].min()) and got[i].station_name == min(f"s{j:03d}" for j in np.flatnonzero(d[i] <= d[i].min() * (1 + 1e-12)))
    assert spatial.nearest_station(points, stations.limit(0), leaf).where("station_name is not null").count() == 0


def test_far_places_leave_boxes_small(spark):
    """One place far away, or a point there, doesn't crowd the boxes, and a dense area gets as many as it needs."""
    rng = np.random.default_rng(2)
    xy = np.vstack([rng.normal([-74, 40.7], 0.001, (3000, 2)), [[0.0, 0.0]]])
    rows = spark.createDataFrame([(i, [float(a), float(b)], 1) for i, (a, b) in enumerate(xy)], "p long, x array<double>, w long")
    tree = nearest.build(rows, 2, leaf=16)
    sizes = tree.rows.groupBy("node").count()
    assert sizes.agg(F.max("count")).first()[0] <= 16 and tree.rows.count() == 3001 and len(tree.levels) <= 6
    asked = spark.createDataFrame([(0, [0.1, 0.1]), (1, [-74.0, 40.7]), (2, [-75.0, 40.7])], "q long, x array<double>")
    per = {r.q: r["count"] for r in nearest.candidates(asked, tree).groupBy("q").count().collect()}
    assert max(per.values()) <= 16 * 30 and per[0] <= 16 * 8


@pytest.mark.parametrize("need", [1, 12])
def test_queries_beside_a_long_strip_of_places(spark, need):
    """Corners of long boxes say little about queries far from them; the rows of a query's own box do."""
    xy = np.array([[i // 15 * 0.005, i % 15 * 0.005] for i in range(30_000)])
    tree = nearest.build(spark.createDataFrame([(i, [float(a), float(b)], 1) for i, (a, b) in enumerate(xy)], "p long, x array<double>, w long"), 2, leaf=32)
    assert tree.rows.groupBy("node").count().agg(F.min("count")).first()[0] >= 12
    at = np.array([[0.3 + i * 0.0007, 0.5 + (i % 5) * 0.1] for i in range(100)])
    asked = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(at)], "q long, x array<double>")
    found = {}
    for r in nearest.candidates(asked, tree, need).select("q", "p").collect():
        found.setdefault(r.q, set()).add(r.p)
    d2 = ((at[:, None] - xy[None]) ** 2).sum(axis=2)
    for i in range(len(at)):
        assert set(np.flatnonzero(d2[i] <= np.sort(d2[i])[need - 1])) <= found[i]
    assert np.mean([len(x) for x in found.values()]) <= 4 * need


def test_equal_places_and_one_value(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)], 1) for i in range(300)], "p long, x array<double>, w long")
    tree = nearest.build(rows, 2, leaf=16)
    assert tree.rows.count() == 300
    got = nearest.neighbourhoods(spark.createDataFrame([(0, [1.0, 0.0])], "q long, x array<double>"), tree, 10).count()
    assert got == 150


@pytest.mark.parametrize("most", [50, 20_000])
def test_quantiles_by_force(spark, most, monkeypatch):
    """Narrowed again and again if a bracket may only hold few rows; ties, nulls, NaN, infinite ends and empty columns."""
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=20_000), rng.integers(0, 5, 20_000).astype(float)
    c = np.where(rng.random(20_000) < 0.4, 7.0, rng.exponential(size=20_000) * 1e9)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), c.tolist())), "a double, b double, c double").repartition(6)
    df = df.withColumn("e", F.lit(None).cast("double")).withColumn("n", F.when(F.col("a") > 1, float("nan")).when(F.col("a") < -1, None).otherwise(F.col("a")))
    qs = [0.0, 0.003, 0.25, 0.5, 0.75, 0.999, 1.0]
    wanted = {f"{col}{i}": (col, q) for col in "abcen" for i, q in enumerate(qs)}
    got = quantiles.exact_quantiles(df, wanted, most=most).first().asDict()
    inside = a[(a >= -1) & (a <= 1)]
    for col, x in (("a", a), ("b", b), ("c", c), ("n", inside)):
        assert np.allclose([got[f"{col}{i}"] for i in range(len(qs))], np.quantile(x, qs), rtol=1e-12, atol=1e-12), col
    assert all(got[f"e{i}"] is None for i in range(len(qs)))


def test_a_sketch_that_misses(spark, monkeypatch):
    """Too small a margin for a small sketch: exact counts notice it and the bracket is opened again."""
    monkeypatch.setattr(quantiles, "SKETCH", 8)
    monkeypatch.setattr(quantiles, "ERROR", 1e-6)
    df = spark.range(30_000).select(((F.col("id") * 7919) % 30_011).cast("double").alias("a"))
    x = np.array([(i * 7919) % 30_011 for i in range(30_000)], float)
    got = quantiles.exact_quantiles(df, {"m": ("a", 0.5), "h": ("a", 0.9)}, most=500).first()
    assert got.m == np.quantile(x, 0.5) and np.isclose(got.h, np.quantile(x, 0.9))


def test_rules_together_are_the_rules(spark):
    df = spark.range(500).select("id", F.when(F.col("id") % 50 == 0, 1000 + F.col("id")).when(F.col("id") % 7 > 0, F.col("id") % 13).cast("double").alias("v"))
    one = anomalies.mad_flag(anomalies.zscore_flag(anomalies.iqr_flag(df, "v", source=df), "v", source=df), "v", source=df)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, anomalies.rule_flags(df, "v").collect()), key=str)
