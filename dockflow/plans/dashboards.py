"""Dashboard jobs: system overview, station detail, map, routes, historical demand, service level, point summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.functions.calendar import WEEKDAYS
from dockflow.functions.cleaning import between_dates, on_days, round_half_even
from dockflow.functions.weather import estimate_humidity
from dockflow.operators.anomalies import daily_anomalies
from dockflow.operators.joins import merge_defaults, routes_with_coords
from dockflow.operators.ranking import topk
from dockflow.operators.rollups import top_routes
from dockflow.operators.series import daily_series, trend_band
from dockflow.operators.spatial import density
from dockflow.session import stage

# Service level per borough used where none was measured.
DEFAULT_SCORES = {"Manhattan": 0.92, "Brooklyn": 0.87, "Queens": 0.78, "Bronx": 0.71, "Staten Island": 0.65}
EMPTY_MESSAGE = "No trips match these filters; choose more dates or weekdays."


def cohens_d(daily: DataFrame, flag: Column, value: str = "trip_count") -> DataFrame:
    """Standardised difference between flagged and other days; 0 where a side has less than two days or no spread."""
    a, b = F.when(flag, F.col(value)), F.when(~flag, F.col(value))
    pooled = F.sqrt((F.pow(F.stddev_samp(a), F.lit(2)) + F.pow(F.stddev_samp(b), F.lit(2))) / 2)
    d = F.when((F.count(a) > 1) & (F.count(b) > 1) & (pooled > 0), (F.avg(a) - F.avg(b)) / F.nullif(pooled, F.lit(0.0)))
    return daily.agg(F.coalesce(d, F.lit(0.0)).alias("weekend_effect"))


def filter_hourly(hourly: DataFrame, start: str | None, end: str | None, days: str | None) -> DataFrame:
    return hourly.where(between_dates(F.col("hour"), start, end) & on_days(F.col("hour"), days))


def overview_kpis(base: DataFrame) -> DataFrame:
    """Total, weekend share, peak hour and weekend effect; zeros when the filter left nothing."""
    by_hour = base.groupBy(F.hour("hour").alias("h")).agg(
        F.sum("trip_count").alias("n"), F.sum(F.when(F.weekday("hour") >= 5, F.col("trip_count")).otherwise(0)).alias("weekend"))
    effect = cohens_d(daily_series(base), F.weekday("date") >= 5).scalar()
    total = F.coalesce(F.sum("n"), F.lit(0))
    share = F.when(total > 0, F.sum("weekend") / F.nullif(total, F.lit(0)) * 100).otherwise(0.0)
    one = by_hour.agg(total.alias("total_trips"), round_half_even(share, 2).alias("weekend_share"),
                      F.coalesce(F.max_by("h", F.struct("n", -F.col("h"))), F.lit(0)).alias("peak_hour"))
    return (one.withColumn("weekend_effect", round_half_even(F.coalesce(effect, F.lit(0.0)), 2))
            .withColumn("message", F.when(F.col("total_trips") == 0, EMPTY_MESSAGE)))


def overview_series(daily: DataFrame, weather: DataFrame) -> DataFrame:
    """Daily trips with temperature, rain and humidity of the day."""
    w = weather.select("date", "temp", F.col("prcp").alias("precip"), estimate_humidity(F.col("date"), F.col("prcp")).alias("humidity"))
    return daily.join(w, "date", "left")


def overview_anomalies(daily: DataFrame, weather: DataFrame, k: float = 2.0) -> DataFrame:
    w = weather.select("date", "temp", F.col("prcp").alias("precip"))
    return (daily_anomalies(daily, k).withColumn("z_score", round_half_even(F.col("z_score"), 2)).join(w, "date", "left"))


def rider_heatmap(daily_demand: DataFrame, riders: tuple[str, ...] = ("casual", "member")) -> DataFrame:
    """Weekday x rider type; the pivot values are given, so no pass is spent on finding them."""
    return daily_demand.groupBy("day_of_week").pivot("member_casual", list(riders)).agg(F.sum("trip_count"))


def system_overview(hourly: DataFrame, daily_demand: DataFrame, weather: DataFrame, start: str | None = None, end: str | None = None,
                    days: str | None = None) -> dict[str, DataFrame]:
    """The five parts of the overview over one kept base of filtered hourly sums (one row per hour of the period)."""
    base = stage(filter_hourly(hourly, start, end, days), "overview")
    daily = daily_series(base)
    return {"kpis": overview_kpis(base), "time_series": overview_series(daily, weather), "trend": trend_band(daily),
            "anomalies": overview_anomalies(daily, weather), "heatmap": rider_heatmap(daily_demand)}


def station_kpis(profile: DataFrame) -> DataFrame:
    """Totals of every station from its weekday x hour table (at most 168 rows per station)."""
    by_hour = profile.groupBy("start_station_name", "hour").agg(F.sum("trip_count").alias("n"))
    return by_hour.groupBy("start_station_name").agg(
        F.sum("n").alias("total_trips"), F.floor(F.sum("n") / 7).cast("long").alias("avg_trips_day"),
        F.max_by("hour", F.struct("n", -F.col("hour"))).alias("peak_hour"))


def station_hour_profile(profile: DataFrame) -> DataFrame:
    return profile.groupBy("start_station_name", "hour").agg(F.avg("trip_count").alias("trip_count"))


def station_day_profile(profile: DataFrame) -> DataFrame:
    """Sum per weekday in the order Monday to Sunday; a weekday without trips is a row with null."""
    sums = profile.groupBy("start_station_name").pivot("day_of_week", WEEKDAYS).agg(F.sum("trip_count"))
    cells = F.array(*[F.struct(F.lit(i).alias("day_index"), F.lit(d).alias("day_of_week"), F.col(d).alias("trip_count")) for i, d in enumerate(WEEKDAYS)])
    return sums.select("start_station_name", F.explode(cells).alias("c")).select("start_station_name", "c.*")


def station_detail(profile: DataFrame, locations: DataFrame, name: str) -> dict[str, DataFrame]:
    """Totals, profiles and location of one station; raises KeyError for an unknown one."""
    rows = stage(profile.where(F.col("start_station_name") == name), "station-profile")
    if rows.isEmpty():
        raise KeyError(f"station not found: {name}")
    return {"kpis": station_kpis(rows), "hourly_profile": station_hour_profile(rows), "daily_profile": station_day_profile(rows),
            "location": locations.where(F.col("station_name") == name).select("lat", "lon").limit(1)}


def map_data(locations: DataFrame, volumes: DataFrame, n: int = 1000) -> DataFrame:
    """Stations with their volume (0 if unknown), the n largest."""
    return topk(locations.join(volumes.select("station_name", "trip_count"), "station_name", "left").fillna({"trip_count": 0}), "trip_count", n, ["station_name"])


def route_data(trips: DataFrame, locations: DataFrame, n: int = 50) -> DataFrame:
    """Top routes with coordinates; the limit comes before the joins, so fewer than n rows may remain."""
    return routes_with_coords(top_routes(trips, n), locations)


def station_list(locations: DataFrame) -> DataFrame:
    return locations.select("station_name").orderBy("station_name")


def historical_demand(history: DataFrame, station, start: str, end: str) -> DataFrame:
    """Hourly demand of one station in a closed range, times as ISO text in UTC."""
    rows = history.select("station_name", "time", "pickups").where((F.col("station_name") == F.lit(station)) & between_dates(F.col("time"), start, end))
    return rows.select(F.concat(F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("date"), F.col("pickups").cast("double").alias("demand"))


def default_scores(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DEFAULT_SCORES.items()), "borough string, score double")


def service_level(scores: DataFrame, defaults: DataFrame) -> DataFrame:
    """Score per area with defaults for missing ones, its class, and whether action is needed."""
    merged = merge_defaults(scores, defaults, "borough", "score")
    level = F.when(F.col("score") >= 0.9, "green").when(F.col("score") >= 0.8, "amber").otherwise("red")
    return merged.select("borough", "score", level.alias("level"), F.when(F.col("score") < 0.8, 1).otherwise(0).alias("intervention"))


def point_summary(points: DataFrame, size: float, kind: str = "kind", weight: str = "weight") -> dict[str, DataFrame]:
    """Weight per cell and rows per type of a point layer."""
    return {"cells": density(points, size, weight),
            "types": points.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"))}


def weekend_share(trips: DataFrame, by: str = "start_station_name") -> DataFrame:
    weekend = F.sum(F.when(F.weekday("started_at") >= 5, 1).otherwise(0))
    return trips.groupBy(by).agg((weekend / F.count(F.lit(1)) * 100).alias("weekend_share"))

