"""Joins of stations, weather, routes and live feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.operators.ranking import latest


def with_weather(df: DataFrame, weather: DataFrame, on: str = "time") -> DataFrame:
    """Left join of weather by time; the weather side is broadcast only when counted small."""
    return df.join(weather, on, "left")


def with_station(df: DataFrame, stations: DataFrame, on: str = "station_name") -> DataFrame:
    return df.join(stations, on, "left")


def pickups_join_dropoffs(pickups: DataFrame, dropoffs: DataFrame) -> DataFrame:
    """Full outer combination of two keyed counts, nulls as 0, expressed as union and sum."""
    return (pickups.unionByName(dropoffs, allowMissingColumns=True).groupBy("station_name", "time")
            .agg(F.coalesce(F.sum("pickups"), F.lit(0)).alias("pickups"), F.coalesce(F.sum("dropoffs"), F.lit(0)).alias("dropoffs"))
            .withColumn("net_demand", F.col("dropoffs") - F.col("pickups")))


def routes_with_coords(top: DataFrame, stations: DataFrame) -> DataFrame:
    """Coordinates of both ends of each (already limited) route; routes without a known end are dropped.

    The route side holds the top n only, so it is the one that may be broadcast; the planner sees the limit.
    """
    start = stations.select(F.col("station_name").alias("start_station_name"), F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"))
    end = stations.select(F.col("station_name").alias("end_station_name"), F.col("lat").alias("end_lat"), F.col("lon").alias("end_lon"))
    return (top.join(start, "start_station_name", "left").join(end, "end_station_name", "left")
            .dropna(subset=["start_lat", "start_lon", "end_lat", "end_lon"]))


def live_stations(info: DataFrame, status: DataFrame, status_order: list[str]) -> DataFrame:
    """Station information joined with its latest status; the last report of an id wins."""
    return info.join(latest(status, ["station_id"], status_order), "station_id")


def recover_stations(facts: DataFrame, default_lat: float = 40.7128, default_lon: float = -74.0060) -> DataFrame:
    """Stations and their first known position from the trips themselves; the default where there is none."""
    return (facts.groupBy("station_name")
            .agg(F.min_by(F.struct("lat", "lon"), F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("time"))).alias("p"))
            .select("station_name", F.coalesce("p.lat", F.lit(default_lat)).alias("lat"), F.coalesce("p.lon", F.lit(default_lon)).alias("lon")))


def merge_defaults(scores: DataFrame, defaults: DataFrame, key: str, value: str) -> DataFrame:
    """Scores with missing (absent, null or 0) values taken from a default table; extra keys stay."""
    d = defaults.select(key, F.col(value).alias("_default"))
    s = scores.select(key, F.col(value).alias("_score"))
    return s.join(d, key, "full_outer").select(key, F.coalesce(F.nullif(F.col("_score"), F.lit(0.0)), F.col("_default"), F.col("_score")).alias(value))


def pred_vs_actual(predictions: DataFrame, actuals: DataFrame, keys: list[str]) -> DataFrame:
    """Each prediction with the first actual of the same hour, or null."""
    hour = F.date_trunc("hour", F.col("time")).cast("timestamp_ntz")
    first = (actuals.withColumn("_h", hour).groupBy(*keys, "_h").agg(F.min_by("actual", "time").alias("actual")))
    return predictions.withColumn("_h", hour).join(first, [*keys, "_h"], "left").drop("_h")
