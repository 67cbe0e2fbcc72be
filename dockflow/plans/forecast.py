"""Forecast job: features at the start, models or station means, calibration, hourly blend, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.functions.calendar import holiday_proximity, hour_columns, season, time_of_day, days_since_epoch, holiday_table
from dockflow.functions.weather import WEATHER_DEFAULTS
from dockflow.operators.forecasting import blend_hourly, calibrate, ensemble, forecast_kpis, horizon, statistical_forecast
from dockflow.operators.models import predictions
from dockflow.operators.preparation import apply_standard, invert_standard
from dockflow.operators.series import history_before, latest_weather, serving_features
from dockflow.schemas import FEATURES
from dockflow.session import stage


def forecast_features(requests: DataFrame, history: DataFrame, dialect: str = "canonical", past: DataFrame | None = None) -> DataFrame:
    """One feature row per request and forecast hour: history features are those at the start for the whole horizon.

    The ``canonical`` dialect is that of the feature table, which models are trained on; ``serve`` has the serving variants of
    time of day, season, days and deviation and a constant distance to holidays. Models never see both. ``past`` is the history before the
    requests if it is staged already.
    """
    serve = dialect == "serve"
    spark = requests.sparkSession
    asked = requests.withColumnRenamed("start", "at_time")
    past = history_before(history, asked.select("station_name", "at_time")) if past is None else past
    static = serving_features(past, ["station_name", "at_time"], sample=not serve).join(latest_weather(past, ["station_name", "at_time"], WEATHER_DEFAULTS), ["station_name", "at_time"])
    hours = horizon(requests).withColumn("at_time", F.col("start"))
    rows = hours.join(static, ["station_name", "at_time"], "left")
    cal = hour_columns(F.col("time"))
    near = ["is_holiday", "days_to_holiday", "days_since_holiday"]
    if serve:
        cal.update(time_of_day=time_of_day(F.hour("time"), "serve"), season=season(F.month("time"), first=0),
                   days_since_epoch=days_since_epoch(F.col("time"), "whole"), days_to_holiday=F.lit(7), days_since_holiday=F.lit(7))
    span = hours.agg(F.year(F.min("time")).alias("a"), F.year(F.max("time")).alias("b")).first()
    days = holiday_table(spark, (span["a"] or 2020) - 1, (span["b"] or 2020) + 1)
    rows = rows.withColumn("date", F.col("time").cast("date"))
    days = days.select("date", F.lit(1).alias("is_holiday")) if serve else holiday_proximity(rows.select("date").distinct(), days)
    rows = rows.join(days, "date", "left")
    fill = {c: WEATHER_DEFAULTS.get(c, 0.0) for c in FEATURES if c not in cal and c not in near}
    cols = {**cal, **{c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()}, **{c: F.coalesce(c, F.lit(0)) for c in near if c not in cal}}
    return rows.select("station_name", "at_time", "time", "step", *[cols[c].cast("double").alias(c) for c in FEATURES])


def forecast_models(requests: DataFrame, history: DataFrame, models: dict, weights: DataFrame, scaler_x: DataFrame | None = None,
                    scaler_y: DataFrame | None = None) -> DataFrame:
    """Ensemble forecast of every request, calibrated on the week before it and blended with its hourly means."""
    past = stage(history_before(history, requests.select("station_name", F.col("start").alias("at_time"))), "forecast-past")
    x = stage(forecast_features(requests, history, past=past), "forecast-features")
    if scaler_x is not None:
        x = apply_standard(x, FEATURES, scaler_x)
    hours = ["station_name", "at_time", "time", "step"]
    pred = ensemble(stage(predictions(x, models, hours), "forecast-votes"), weights, hours)  # read three times
    value = F.col("predicted") if scaler_y is None else invert_standard(F.col("predicted"), scaler_y, "pickups", None)
    pred = pred.withColumn("predicted", F.greatest(value, F.lit(0.0)))
    keys = ("station_name", "at_time")
    return blend_hourly(calibrate(pred, past, keys=keys), past, keys=keys)


def forecast(requests: DataFrame, history: DataFrame, models: dict | None = None, weights: DataFrame | None = None, **scalers) -> dict[str, DataFrame]:
    """Predictions and their summary; station means stand in where no model is given."""
    if models:
        pred = forecast_models(requests, history, models, weights, **scalers)
    else:
        pred = statistical_forecast(requests, history)
    return {"predictions": pred, "kpis": forecast_kpis(pred, ["station_name"])}
