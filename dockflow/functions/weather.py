"""Weather columns: interactions, extremes, estimates and the seasonal stand-in table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.operators.quantiles import attach

# What a missing measurement counts as, and the rain classes in mm per hour.
WEATHER_DEFAULTS = {"temp": 15.0, "prcp": 0.0, "wspd": 5.0}
RAIN_CLASSES = [(0.0, "None"), (2.5, "Light"), (7.6, "Moderate")]


def interactions(df: DataFrame) -> DataFrame:
    """Products of weather with the time of day, plus the felt temperature."""
    c = F.col
    return df.select(
        "*", (c("temp") * c("hour") / 24).alias("temp_hour_interaction"),
        (c("temp") * c("is_weekend")).alias("temp_weekend_interaction"),
        (c("temp") * c("is_rush_hour")).alias("temp_rush_interaction"),
        (c("prcp") * c("is_weekend")).alias("rain_weekend"),
        (c("prcp") * c("is_rush_hour")).alias("rain_rush_hour"),
        (c("temp") - 0.4 * c("wspd")).alias("feels_like"))


def extremes(df: DataFrame, weather: DataFrame | None = None, copies: Column | None = None) -> DataFrame:
    """Hot, cold, windy and rainy flags against the 10 % and 90 % quantiles of the weather.

    On a full station x hour grid every hour occurs once per station. Give the hourly table as ``weather`` and the number
    of stations as ``copies`` to take exactly the grid's quantiles from the hours alone; else ``df`` itself is used. The
    quantile buffer holds distinct measurements, at most one per hour.
    """
    base = weather if weather is not None else df
    times = copies if copies is not None else F.lit(1)
    base = base.select("temp", "wspd", times.alias("copies"))
    q = base.agg(F.percentile("temp", 0.9, F.col("copies")).alias("hot"), F.percentile("temp", 0.1, F.col("copies")).alias("cold"),
                 F.percentile("wspd", 0.9, F.col("copies")).alias("windy"))
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    out = attach(df, q).select(
        "*", flag(F.col("temp") > F.col("_s.hot")).alias("is_hot"), flag(F.col("temp") < F.col("_s.cold")).alias("is_cold"),
        flag(F.col("prcp") > 1.0).alias("is_rainy"), flag(F.col("wspd") > F.col("_s.windy")).alias("is_windy")).drop("_s")
    return out.withColumn("bad_weather", F.greatest("is_rainy", "is_cold", "is_windy"))


def estimate_humidity(date: Column, prcp: Column) -> Column:
    """55, plus 25 in rain, plus a day-dependent 0..19, within 30..100."""
    spread = F.pmod(F.datediff(date, F.lit("1970-01-01").cast("date")), F.lit(20))
    raw = F.lit(55) + F.when(prcp > 0, 25).otherwise(0) + spread
    return F.greatest(F.lit(30), F.least(F.lit(100), raw))


def rain_class(prcp: Column) -> Column:
    out = None
    for top, name in RAIN_CLASSES:
        out = F.when(prcp <= top, name) if out is None else out.when(prcp <= top, name)
    return out.otherwise("Heavy")


def seasonal_weather(hours: DataFrame, start: Column, daily_swing: float = 0.0) -> DataFrame:
    """Weather table to use when none was delivered: a yearly sine, optionally with a daily one."""
    days = F.timestamp_diff("SECOND", start, F.col("time")) / F.lit(86400.0)
    year = F.sin(F.lit(2 * math.pi) * days / F.lit(365.0))
    day = F.sin(F.lit(2 * math.pi) * F.hour("time") / F.lit(24.0))
    return hours.select("time", (15.0 + 15.0 * year + daily_swing * day).alias("temp"), F.lit(0.0).alias("prcp"),
                        (10.0 + 5.0 * year).alias("wspd"))
