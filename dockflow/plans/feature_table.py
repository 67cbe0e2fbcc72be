"""The feature table of the demand model: from trips to one row per station and hour with 54 features."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.functions.calendar import holiday_table, hour_dimension
from dockflow.functions.cleaning import keep_stations
from dockflow.functions.weather import extremes, interactions
from dockflow.operators.quantiles import bounded_quantiles
from dockflow.operators.rollups import station_hourly, station_quality, top_stations
from dockflow.operators.series import add_lags, add_rolling, densify, ema, ffill_bfill
from dockflow.schemas import EMA_SPAN, FEATURES, LAGS, ROLLING
from dockflow.session import stage


def kept_series(trips: DataFrame, n_stations: int | None = None) -> DataFrame:
    """Hourly series of all stations, or of the best ``n_stations`` by quality.

    Both the full and the kept series are staged: the trips, by far the largest table, are read once, and everything that
    follows (quality, ends of the grid, hours, windows) starts from the much smaller table of station hours.
    """
    series = stage(station_hourly(trips), "station-hourly")
    if n_stations is None:
        return series
    return stage(keep_stations(series, top_stations(station_quality(series), n_stations)), "kept-series")


def span(series: DataFrame) -> tuple[datetime.datetime, datetime.datetime] | None:
    """First and last hour of a series."""
    row = series.agg(F.min("time").alias("lo"), F.max("time").alias("hi")).first()
    return (row["lo"], row["hi"]) if row["lo"] is not None else None


def hour_spine(spark: SparkSession, lo: datetime.datetime, hi: datetime.datetime) -> DataFrame:
    """Every hour between two hours."""
    hours = int((hi - lo).total_seconds() // 3600) + 1
    start = F.lit(lo.isoformat(sep=" ")).cast("timestamp_ntz")
    return spark.range(hours).select(F.timestamp_add("HOUR", F.col("id").cast("int"), start).alias("time"))


def hour_features(series: DataFrame, weather: DataFrame, with_extremes: bool = False) -> DataFrame:
    """Weather and calendar per hour of the series.

    Gaps in the delivered weather are filled in time order, hours without any weather get the median. Done once per hour;
    over the full grid every hour counts equally, so the medians are those of the grid.
    """
    spark = series.sparkSession
    measures = ["temp", "prcp", "wspd"]
    ends = span(series)
    lo, hi = ends or (datetime.datetime(2020, 1, 1), datetime.datetime(2019, 12, 31, 23))
    hours = hour_spine(spark, lo, hi)
    filled = ffill_bfill(weather.select("time", *measures), measures, "time")
    hourly = stage(hours.join(filled, "time", "left"), "hour-weather")
    medians = bounded_quantiles(hourly, {c: (c, 0.5) for c in measures}).first().asDict()
    out = hourly.fillna({c: v for c, v in medians.items() if v is not None})
    out = out.join(hour_dimension(hours, holiday_table(spark, lo.year - 1, hi.year + 1)), "time")
    if with_extremes:
        copies = series.agg(F.count_distinct("station_name")).scalar()
        out = extremes(interactions(out), out, copies)
    return out


def add_history(grid: DataFrame, col: str = "pickups") -> DataFrame:
    """Lags, rolling statistics and exponential average; one shuffle by station for all of them.

    The average comes first: it orders rows twice, which is cheaper while they are narrow.
    """
    return add_rolling(add_lags(ema(grid, col, EMA_SPAN, f"ema_{EMA_SPAN}h"), col, LAGS), col, ROLLING)


def feature_table(trips: DataFrame, weather: DataFrame, n_stations: int | None = None, with_extremes: bool = False, series: DataFrame | None = None) -> DataFrame:
    """Station, hour, target and the 54 features in their order, for all rows of the complete grid.

    Pass a staged ``series`` when it is also used elsewhere, so that trips are read once.
    """
    series = kept_series(trips, n_stations) if series is None else series
    history = add_history(densify(series, ["pickups", "dropoffs", "net_demand"]))
    # staged, so that its size, one row per hour of the period, is known before the grid would be shuffled for the join
    hours = stage(hour_features(series, weather, with_extremes), "hour-features")
    extra = [c for c in hours.columns if c not in FEATURES and c != "time"]
    return history.join(hours, "time", "left").select("station_name", "time", "pickups", "dropoffs", "net_demand", *FEATURES, *extra)


def training_rows(features: DataFrame) -> DataFrame:
    """Rows with a week of history behind them."""
    return features.dropna(subset=["lag_24h", "lag_168h", "roll_mean_24h"])


def evaluation_features(trips: DataFrame, weather: DataFrame) -> DataFrame:
    """Variant used for out-of-sample tests: sparse series (lags are previous rows), undefined history as 0 (deviation 1)."""
    series = stage(station_hourly(trips), "station-hourly")
    history = ema(series, "pickups", EMA_SPAN, f"ema_{EMA_SPAN}h", fill=0.0)
    history = add_rolling(add_lags(history, "pickups", LAGS, fill=0), "pickups", ROLLING, zero_fill=True)
    return history.join(hour_features(series, weather), "time", "left")
