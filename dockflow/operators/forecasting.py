"""Forecasts for all stations at once: horizon, statistical model, ensemble, calibration and blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.operators.quantiles import scalar_struct


def horizon(requests: DataFrame, start: str = "start", end: str = "end", most: int | None = 168, mark: str | None = None) -> DataFrame:
    """One row per forecast hour, one hour at least and ``most`` hours at most; None for no limit. ``mark`` names a column that tells
    requests that were cut."""
    asked = F.floor(F.timestamp_diff("SECOND", F.col(start), F.col(end)) / 3600)
    hours = F.greatest(F.lit(1), asked if most is None else F.least(F.lit(most), asked)).cast("int")
    rows = requests if mark is None else requests.withColumn(mark, F.lit(False) if most is None else F.coalesce(asked > most, F.lit(False)))
    return (rows.withColumn("step", F.explode(F.sequence(F.lit(0), hours - 1)))
            .withColumn("time", F.col(start) + F.make_dt_interval(F.lit(0), F.col("step"))))


def station_means(history: DataFrame, value: str = "pickups") -> DataFrame:
    """Mean by hour, by weekday and overall per station as two maps and a number: one row per station.

    The rows fold into at most 168 (hour, weekday) cells per station before the maps are built.
    """
    cells = (history.groupBy("station_name", F.hour("time").alias("hour"), F.weekday("time").alias("dow"))
             .agg(F.sum(value).cast("double").alias("s"), F.count(value).alias("n")))
    by_hour = cells.groupBy("station_name", "hour").agg((F.sum("s") / F.sum("n")).alias("m"))
    by_dow = cells.groupBy("station_name", "dow").agg((F.sum("s") / F.sum("n")).alias("m"))
    overall = cells.groupBy("station_name").agg((F.sum("s") / F.sum("n")).alias("overall_mean"))
    maps = (by_hour.groupBy("station_name").agg(F.map_from_entries(F.collect_list(F.struct("hour", "m"))).alias("hour_mean"))
            .join(by_dow.groupBy("station_name").agg(F.map_from_entries(F.collect_list(F.struct("dow", "m"))).alias("dow_mean")), "station_name"))
    return maps.join(overall, "station_name")


def blend_means(hour: Column, dow: Column) -> Column:
    """0.6 hour mean + 0.3 weekday mean + 0.1 overall mean, missing means replaced by the overall one, at least 0."""
    o = F.col("overall_mean")
    value = 0.6 * F.coalesce(F.try_element_at("hour_mean", hour), o) + 0.3 * F.coalesce(F.try_element_at("dow_mean", dow), o) + 0.1 * o
    return F.greatest(value, F.lit(0.0))


def rule_forecast(time: Column) -> Column:
    """Demand by rule when a station has no history at all."""
    hour = F.hour(time)
    base = (F.when(hour.between(7, 9) | hour.between(17, 19), 25.0).when(hour.between(9, 17), 18.0)
            .when(hour.between(19, 22), 15.0).otherwise(12.0))
    return F.when(F.weekday(time) >= 5, base * 0.7).otherwise(base)


def statistical_forecast(requests: DataFrame, history: DataFrame, value: str = "pickups") -> DataFrame:
    """Forecast of every requested (station, start, end) from the station's means, by rule where it has no history."""
    hours = horizon(requests)
    joined = hours.join(station_means(history, value), "station_name", "left")
    pred = F.when(F.col("overall_mean").isNull(), rule_forecast(F.col("time"))).otherwise(blend_means(F.hour("time"), F.weekday("time")))
    return joined.select("station_name", "time", "step", pred.alias("predicted"))


def inverse_mae_weights(metrics: DataFrame) -> DataFrame:
    """Weight of each model: inverse error, normalised; one row per model. Models without any error share all the weight."""
    inverse = 1.0 / F.nullif(F.col("mae").cast("double"), F.lit(0.0))
    one = metrics.agg(F.sum(inverse).alias("total"), F.count_if(F.col("mae") == 0).alias("exact"))
    s = scalar_struct(one)
    share = F.when(s.getField("exact") > 0, F.when(F.col("mae") == 0, 1.0 / F.nullif(s.getField("exact"), F.lit(0))).otherwise(0.0)).otherwise(inverse / s.getField("total"))
    return metrics.select("model", "mae", share.alias("weight"))


def ensemble(predictions: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean over the models present; a model without a weight counts as one of n equal ones."""
    w = predictions.join(weights.select("model", "weight"), "model", "left")
    n = predictions.agg(F.count_distinct("model")).scalar()
    weight = F.coalesce("weight", 1.0 / n)
    return w.withColumn("_w", weight).groupBy(*keys).agg((F.sum(F.col("_w") * F.col("predicted")) / F.sum("_w")).alias("predicted"))


def calibrate(predictions: DataFrame, history: DataFrame, value: str = "pickups", keys: tuple[str, ...] = ("station_name",)) -> DataFrame:
    """Stretch the forecast towards the spread of the history (1 to 5 times) around its mean, at least 0.

    Needs more than ten history rows and some spread; otherwise the forecast stays as it is.
    """
    h = history.groupBy(*keys).agg(F.count(value).alias("_hn"), F.avg(value).alias("_hm"), F.stddev_pop(value).alias("_hs"))
    p = predictions.groupBy(*keys).agg(F.avg("predicted").alias("_pm"), F.stddev_pop("predicted").alias("_ps"))
    stats = p.join(h, list(keys), "left")
    ps = F.when(F.col("_ps") > 0, F.col("_ps")).otherwise(1.0)
    factor = F.least(F.greatest(F.col("_hs") / ps, F.lit(1.0)), F.lit(5.0))
    stretched = F.greatest(F.col("_hm") + (F.col("predicted") - F.col("_pm")) * factor, F.lit(0.0))
    usable = (F.col("_hn") > 10) & (F.col("_hs") > 0)
    return (predictions.join(stats, list(keys)).withColumn("predicted", F.when(usable, stretched).otherwise(F.col("predicted")))
            .select(*predictions.columns))


def blend_hourly(predictions: DataFrame, history: DataFrame, value: str = "pickups", keys: tuple[str, ...] = ("station_name",), share: float = 0.3) -> DataFrame:
    """Mix the forecast with the mean of the history at that hour, where there is one."""
    means = history.groupBy(*keys, F.hour("time").alias("_h")).agg(F.avg(value).alias("_m"))
    out = predictions.withColumn("_h", F.hour("time")).join(means, [*keys, "_h"], "left")
    mixed = (1 - share) * F.col("predicted") + share * F.col("_m")
    return out.withColumn("predicted", F.coalesce(mixed, F.col("predicted"))).select(*predictions.columns)


def forecast_kpis(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Whole number of the sum, first peak time, peak value and mean of each forecast."""
    return predictions.groupBy(*keys).agg(
        F.floor(F.sum("predicted")).cast("long").alias("total"),
        F.date_format(F.min_by("time", F.struct(-F.col("predicted"), F.col("time"))), "HH:mm").alias("peak_time"),
        F.max("predicted").alias("peak"), F.avg("predicted").alias("mean"))
