"""Edge rules on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dockflow.functions import cleaning as c
from dockflow.operators import anomalies, evaluation, forecasting, joins, quantiles, ranking, rollups, series
from dockflow.plans import dashboards, operations

H = dt.timedelta(hours=1)
T0 = dt.datetime(2024, 3, 1)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def hourly(spark, rows):
    return frame(spark, [(s, T0 + i * H, p) for s, i, p in rows], "station_name string, time timestamp_ntz, pickups long")


def test_trips_without_station_or_end_do_not_count(spark):
    t = frame(spark, [("a", "", T0, T0 + H), (None, "a", T0, None), ("a", "b", T0, T0 + 2 * H)],
              "start_station_name string, end_station_name string, started_at timestamp_ntz, ended_at timestamp_ntz")
    got = {(r.station_name, r.time): (r.pickups, r.dropoffs, r.net_demand) for r in rollups.station_hourly(t).collect()}
    assert got == {("a", T0): (2, 0, -2), ("b", T0 + 2 * H): (0, 1, 1)}


def test_one_row_station_has_no_score_and_unit_deviation(spark):
    s = hourly(spark, [("one", 0, 5), ("two", 0, 1), ("two", 1, 3)])
    q = {r.station_name: r for r in rollups.station_quality(s).collect()}
    assert q["one"].std is None and q["one"].score is None and q["two"].score is not None
    assert [r.station_name for r in rollups.top_stations(rollups.station_quality(s), 5).collect()] == ["two"]
    assert {r.station_name: r.std_demand for r in rollups.station_metadata(s).collect()}["one"] == 1.0


def test_grid_is_complete_for_every_station(spark):
    s = hourly(spark, [("a", 0, 5), ("a", 4, 1), ("b", 2, 3)])
    got = sorted((r.station_name, (r.time - T0) // H, r.pickups) for r in series.densify(s, ["pickups"]).collect())
    assert got == [("a", i, {0: 5, 4: 1}.get(i, 0)) for i in range(5)] + [("b", i, {2: 3}.get(i, 0)) for i in range(5)]


def test_windows_do_not_cross_stations(spark):
    s = hourly(spark, [("a", i, 9) for i in range(6)] + [("b", i, 1) for i in range(6)])
    out = series.add_rolling(series.add_lags(s, "pickups", [1]), "pickups", [4, 12])
    first = {r.station_name: r for r in out.where(F.col("time") == F.lit(T0).cast("timestamp_ntz")).collect()}
    assert first["b"].lag_1h is None and first["b"].roll_mean_4h is None and first["b"].roll_std_4h == 1.0
    last = {r.station_name: r for r in out.where(F.col("time") == F.lit(T0 + 5 * H).cast("timestamp_ntz")).collect()}
    assert last["b"].roll_max_12h == 1 and last["a"].roll_min_12h == 9 and last["a"].roll_std_12h == 0.0


def test_daily_gaps_are_zero_and_day_filter_reinserts_days(spark):
    h = frame(spark, [(dt.datetime(2024, 3, 1, 5), 2), (dt.datetime(2024, 3, 4, 7), 3)], "hour timestamp_ntz, trip_count long")
    assert [(r.date.day, r.trip_count) for r in series.daily_series(h).orderBy("date").collect()] == [(1, 2), (2, 0), (3, 0), (4, 3)]


def test_date_only_end_is_midnight(spark):
    h = frame(spark, [(dt.datetime(2024, 3, 1), 1), (dt.datetime(2024, 3, 1, 1), 1)], "hour timestamp_ntz, trip_count long")
    assert dashboards.filter_hourly(h, None, "2024-03-01", None).count() == 1


def test_tied_peak_takes_the_smallest_hour_and_empty_gives_zeros(spark):
    h = frame(spark, [(dt.datetime(2024, 3, 1, 9), 4), (dt.datetime(2024, 3, 1, 5), 4)], "hour timestamp_ntz, trip_count long")
    k = dashboards.overview_kpis(h).first()
    assert (k.peak_hour, k.total_trips, k.weekend_effect, k.message) == (5, 8, 0.0, None)
    e = dashboards.overview_kpis(h.where("trip_count > 9")).first()
    assert (e.total_trips, e.weekend_share, e.peak_hour, e.weekend_effect) == (0, 0.0, 0, 0.0) and e.message


def test_weekend_effect_needs_spread(spark):
    rows = [(dt.datetime(2024, 3, d), 5) for d in range(1, 15)]
    assert dashboards.overview_kpis(frame(spark, rows, "hour timestamp_ntz, trip_count long")).first().weekend_effect == 0.0


def test_unknown_station_and_missing_weekday(spark):
    p = frame(spark, [("a", "Monday", 3, 5), ("a", "Sunday", 3, 2)], "start_station_name string, day_of_week string, hour int, trip_count long")
    loc = frame(spark, [("a", 1.0, 2.0)], "station_name string, lat double, lon double")
    with pytest.raises(KeyError):
        dashboards.station_detail(p, loc, "b")
    days = [(r.day_of_week, r.trip_count) for r in dashboards.station_detail(p, loc, "a")["daily_profile"].orderBy("day_index").collect()]
    assert days[0] == ("Monday", 5) and days[1] == ("Tuesday", None) and days[6] == ("Sunday", 2)


STATUS = "station_id long, last_reported long, bikes long, ebikes long, docks long, is_renting int"


def test_last_report_wins_and_zero_capacity(spark):
    info = frame(spark, [(1, "x", 0), (2, None, 10)], "station_id long, name string, capacity long")
    st = frame(spark, [(1, 5, 3, 0, 2, 1), (1, 9, 0, 0, 0, 1), (2, 1, 10, 1, 0, 0)], STATUS)
    s = operations.station_state(info, st, ["last_reported"])
    got = {r.station_id: r for r in s.collect()}
    assert got[1].bikes == 0 and got[1].fill_rate == 0.0 and got[2].name == "Unknown Station" and got[2].fill_rate_sum == 1.1
    a = {r.station_id: r for r in operations.rebalancing_actions(s).collect()}
    assert (a[1].capacity, a[1].action, a[1].quantity, a[1].priority) == (30, "RESTOCK", 12, "CRITICAL")
    assert (a[2].action, a[2].quantity, a[2].priority, a[2].fill_pct) == ("PICKUP", 4, "CRITICAL", 100)
    assert operations.fleet_kpis(operations.rebalancing_actions(s).where("false")).first().health == 100


def test_zero_score_takes_default_and_extra_area_stays(spark):
    s = frame(spark, [("Queens", 0.0), ("Harbor", 0.95)], "borough string, score double")
    got = {r.borough: (r.score, r.level, r.intervention) for r in dashboards.service_level(s, dashboards.default_scores(spark)).collect()}
    assert got["Queens"] == (0.78, "red", 1) and got["Harbor"] == (0.95, "green", 0) and got["Brooklyn"] == (0.87, "amber", 0) and len(got) == 6


def test_mape_leaves_out_zero_actuals(spark):
    p = frame(spark, [(0.0, 1.0), (2.0, 1.0)], "actual double, predicted double")
    assert evaluation.metrics(p).first().mape == 50.0
    assert evaluation.shown_accuracy(p).first().mape == 25.0
    one = frame(spark, [(3.0, 1.0)], "actual double, predicted double")
    assert evaluation.metrics(one).first().r2 is None


def test_rounding_towards_actual(spark):
    p = frame(spark, [(3.0, 1.2), (1.0, 1.7), (None, 1.5)], "actual double, predicted double")
    assert [r.predicted for r in evaluation.round_towards(p).collect()] == [2, 1, 2]


def test_short_history_features(spark):
    s = hourly(spark, [("a", i, i) for i in range(5)])
    ask = frame(spark, [("a", T0 + 4 * H)], "station_name string, at_time timestamp_ntz")
    f = series.serving_features(series.history_before(s, ask), ["station_name", "at_time"]).first()
    assert (f.n_hist, f.lag_1h, f.lag_3h, f.lag_6h, f.roll_mean_4h, f.roll_mean_12h, f.ema_24h) == (4, 3.0, 1.0, 0.0, 1.5, 0.0, 0.0)


def test_forecast_without_history_and_calibration_without_spread(spark):
    req = frame(spark, [("new", T0, T0 + H)], "station_name string, start timestamp_ntz, end timestamp_ntz")
    none = hourly(spark, [("a", 0, 1)])
    r = forecasting.statistical_forecast(req, none).collect()
    assert len(r) == 1 and r[0].predicted == 12.0
    flat = hourly(spark, [("a", i, 2) for i in range(20)])
    pred = frame(spark, [("a", T0, 1.0), ("a", T0 + H, 3.0)], "station_name string, time timestamp_ntz, predicted double")
    assert sorted(x.predicted for x in forecasting.calibrate(pred, flat).collect()) == [1.0, 3.0]


def test_names_and_rounding(spark):
    df = frame(spark, [("a--b",), ("a<b",), ("ok-name",)], "n string")
    assert [r.n for r in df.where(c.valid_name(F.col("n"))).collect()] == ["ok-name"]
    v = frame(spark, [(-1.7, 0.5, 2.5)], "a double, b double, c double")
    r = v.select(c.truncate(F.col("a")).alias("t"), c.round_half_even(F.col("b")).alias("e"), c.round_half_up(F.col("c")).alias("u")).first()
    assert (r.t, r.e, r.u) == (-1, 0.0, 3)


def test_outer_counts(spark):
    ups = frame(spark, [("a", T0, 2)], "station_name string, time timestamp_ntz, pickups long")
    downs = frame(spark, [("b", T0, 1)], "station_name string, time timestamp_ntz, dropoffs long")
    got = sorted((r.station_name, r.pickups, r.dropoffs) for r in joins.pickups_join_dropoffs(ups, downs).collect())
    assert got == [("a", 2, 0), ("b", 0, 1)]


def test_hot_key_dedup_keeps_first(spark):
    df = spark.range(100_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    out = ranking.dedup_first(df, ["k"], ["v"])
    assert out.where("k = 0").first().v == 0


def test_constant_column_has_no_outliers(spark):
    df = spark.range(50).select(F.col("id"), F.lit(3.0).alias("v"))
    out = anomalies.zscore_flag(anomalies.iqr_flag(df, "v"), "v")
    assert out.agg(F.sum("iqr_outlier"), F.sum("z_outlier")).first()[:] == (0, 0)
    assert quantiles.histogram(df, "v", 10).collect()[0].n == 50
