"""Operators against pandas, numpy or brute force on random data."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dockflow.operators import anomalies, preparation, quantiles, ranking, series, spatial

T0 = dt.datetime(2024, 1, 1)


def long_series(spark, n=2000, seed=1):
    rng = np.random.default_rng(seed)
    pdf = pd.concat([pd.DataFrame({"station_name": s, "time": pd.date_range(T0, periods=n, freq="h"), "pickups": rng.poisson(m, n)}) for s, m in (("a", 3), ("b", 40))])
    schema = "station_name string, time timestamp_ntz, pickups long"
    return pdf, spark.createDataFrame(pdf, schema).repartition(5)


@pytest.mark.parametrize("span", [2, 24, 5000])
def test_ema(spark, span):
    pdf, df = long_series(spark)
    got = series.ema(df, "pickups", span, "e").toPandas().sort_values(["station_name", "time"])["e"].to_numpy()
    want = pdf.groupby("station_name")["pickups"].transform(lambda x: x.shift(1).ewm(span=span, adjust=False).mean()).to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_rolling(spark):
    pdf, df = long_series(spark, 700)
    windows = [4, 10, 24, 168]
    got = series.add_rolling(df, "pickups", windows, std_fill=None).toPandas().sort_values(["station_name", "time"])
    for n in windows:
        for stat in ("mean", "std", "min", "max"):
            want = pdf.groupby("station_name")["pickups"].transform(lambda x: getattr(x.shift(1).rolling(n, min_periods=1), stat)())
            np.testing.assert_allclose(got[f"roll_{stat}_{n}h"].to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("accuracy", [20, 1000, 100_000])
def test_quantiles_are_exact_whatever_the_sketch(spark, accuracy):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=6001), np.zeros(3000), np.full(500, 1e6)])
    df = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(6)
    qs = [0.0, 0.01, 0.25, 0.5, 0.733, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, {f"q{i}": ("v", q) for i, q in enumerate(qs)}, accuracy).first()
    np.testing.assert_allclose(list(got), np.quantile(v, qs), rtol=1e-12, atol=1e-12)


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 7.0), (None, None)], "a double, b double")
    r = quantiles.exact_quantiles(df, {"a": ("a", 0.5), "b": ("b", 0.9)}).first()
    assert (r.a, r.b) == (1.5, 7.0)


def test_nearest_station(spark):
    rng = np.random.default_rng(3)
    st = pd.DataFrame({"station_name": [f"s{i}" for i in range(300)], "lat": rng.normal(40, 0.02, 300), "lon": rng.normal(-74, 0.02, 300)})
    st.loc[7:20, ["lat", "lon"]] = 40.01, -74.01  # several stations at one place
    pt = pd.DataFrame({"point_id": range(2000), "lat": rng.uniform(39.5, 40.5, 2000), "lon": rng.uniform(-74.5, -73.5, 2000)})
    pt.loc[:900, ["lat", "lon"]] = 40.3, -73.7  # a third of the points at one place
    got = spatial.nearest_station(spark.createDataFrame(pt), spark.createDataFrame(st)).toPandas().set_index("point_id").sort_index()
    d = np.sqrt((pt.lat.to_numpy()[:, None] - st.lat.to_numpy()) ** 2 + (pt.lon.to_numpy()[:, None] - st.lon.to_numpy()) ** 2)
    np.testing.assert_allclose(got["dist"].to_numpy(), d.min(axis=1), rtol=1e-12)
    dist_of = {n: i for i, n in enumerate(st.station_name)}
    np.testing.assert_allclose([d[i, dist_of[n]] for i, n in enumerate(got["station_name"])], d.min(axis=1))


def test_match_by_volume(spark):
    rng = np.random.default_rng(4)
    st = pd.DataFrame({"station_name": [f"s{i:03d}" for i in range(200)], "trip_count": rng.integers(1, 5000, 200)})
    ts = rng.integers(1, 6000, 400)
    got = {r.target: (r.station_name, r.diff) for r in spatial.match_by_volume(spark.createDataFrame([(int(t),) for t in ts], "target long"), spark.createDataFrame(st)).collect()}
    for t in ts:
        best = min((abs(v - t), v, n) for n, v in zip(st.station_name, st.trip_count))
        want = (best[2], float(best[0])) if best[0] < 0.1 * t else (None, None)
        assert got[float(t)] == want


def test_spectrum_finds_the_daily_cycle(spark):
    hours = pd.date_range(T0, periods=24 * 30, freq="h")
    pdf = pd.DataFrame({"station_name": "a", "time": hours, "pickups": (10 + 8 * np.sin(2 * np.pi * np.arange(len(hours)) / 24)).round().astype(int)})
    df = spark.createDataFrame(pdf, "station_name string, time timestamp_ntz, pickups long")
    top = anomalies.dominant_periods(df).orderBy("rank").first()
    assert abs(top.freq - 1 / 24) < 1e-9
    power = {r.period: r.power for r in anomalies.periodogram(df, [24.0, 12.0]).collect()}
    assert power[24.0] > 10 * power[12.0] and abs(power[24.0] - top.power) / top.power < 1e-9


def test_outlier_models_rank_the_odd_row_first(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"k": range(600), "a": rng.normal(size=600), "b": rng.normal(size=600)})
    pdf.loc[17, ["a", "b"]] = 25.0, -25.0
    df = spark.createDataFrame(pdf)
    assert anomalies.isolation_forest(df, ["k"], ["a", "b"], trees=20).orderBy(F.desc("iso_score")).first().k == 17
    lof = anomalies.local_outlier_factor(df, ["k"], ["a", "b"], k=10).orderBy(F.desc("lof")).collect()
    assert lof[0].k == 17 and len(lof) == 600 and 0 < sum(r.lof_outlier for r in lof) <= 31
    x = pdf[["a", "b"]].to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    nn = np.argsort(d, axis=1)[:, :10]
    kd = np.sort(d, axis=1)[:, 9]
    lrd = 1 / (np.maximum(np.take_along_axis(d, nn, 1), kd[nn]).mean(axis=1) + 1e-10)
    want = lrd[nn].mean(axis=1) / lrd
    np.testing.assert_allclose([r.lof for r in sorted(lof, key=lambda r: r.k)], want, rtol=1e-9)


def test_split_and_folds(spark):
    pdf, df = long_series(spark, 100)
    order = pdf.sort_values(["time", "station_name"]).reset_index(drop=True)
    got = preparation.time_split(df, 0.73).toPandas().sort_values(["time", "station_name"])["is_train"].to_numpy()
    assert (got == (np.arange(200) < int(200 * 0.73))).all()
    folds = preparation.time_folds(df, 3).toPandas().sort_values(["time", "station_name"])["fold"].to_numpy()
    assert (folds == np.repeat([0, 1, 2, 3], 50)).all() and len(order) == 200


def test_samples_repeat_and_denoise_keeps_short_series(spark):
    df = spark.range(10_000)
    a = ranking.sample_fraction(df, ["id"], 0.1)
    assert 800 < a.count() < 1200 and a.exceptAll(ranking.sample_fraction(df.repartition(3), ["id"], 0.1)).count() == 0
    assert ranking.sample_rows(df, ["id"], 50).count() == 50
    pdf, s = long_series(spark, 50)
    out = anomalies.denoise(s, "pickups")
    assert out.where(F.col("pickups_denoised") != F.col("pickups")).count() == 0


def test_lags_equal_rows_back_and_sequences(spark):
    pdf, s = long_series(spark, 60)
    seq = series.sequences(s, "pickups", 24)
    assert seq.count() == 72
    r = seq.where("station_name = 'a'").orderBy("time").first()
    assert list(r.seq) == pdf[pdf.station_name == "a"].pickups.tolist()[:24]
