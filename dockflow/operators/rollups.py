"""Rollups of trips: hourly, daily, station, route and system tables, and the station quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.functions.cleaning import clip, hour_bin, valid_station
from dockflow.functions.calendar import day_name


def station_hourly(trips: DataFrame) -> DataFrame:
    """Pickups, dropoffs and net demand per station and hour in one pass over the trips.

    Every trip becomes two signed half rows inside the scan stage; partial sums leave one row per station and hour and
    task, so a station that holds a third of the trips adds no more shuffle rows than any other.
    """
    halves = trips.select(F.explode(F.array(
        F.struct(F.col("start_station_name").alias("station_name"), hour_bin(F.col("started_at")).alias("time"),
                 F.lit(1).alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("end_station_name").alias("station_name"), hour_bin(F.col("ended_at")).alias("time"),
                 F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("h")).select("h.*")
    return (halves.where(valid_station(F.col("station_name")) & F.col("time").isNotNull())
            .groupBy("station_name", "time").agg(F.sum("up").alias("pickups"), F.sum("down").alias("dropoffs"))
            .withColumn("net_demand", F.col("dropoffs") - F.col("pickups")))


def hourly_demand(trips: DataFrame) -> DataFrame:
    return trips.groupBy(hour_bin(F.col("started_at")).alias("hour")).agg(F.count(F.lit(1)).alias("trip_count"))


def daily_demand(trips: DataFrame) -> DataFrame:
    return (trips.groupBy(day_name(F.col("started_at")).alias("day_of_week"), "member_casual")
            .agg(F.count(F.lit(1)).alias("trip_count")))


def station_hourly_demand(trips: DataFrame) -> DataFrame:
    return (trips.groupBy("start_station_name", day_name(F.col("started_at")).alias("day_of_week"),
                          F.hour("started_at").alias("hour"))
            .agg(F.count(F.lit(1)).alias("trip_count")))


def demand_rollups(trips: DataFrame) -> DataFrame:
    """The hourly, the weekday x rider and the station x weekday x hour tables in one scan; ``level`` tells them apart."""
    base = trips.select(hour_bin(F.col("started_at")).alias("time"), day_name(F.col("started_at")).alias("day_of_week"),
                        "member_casual", "start_station_name", F.hour("started_at").alias("hour"))
    time, day, rider, station, hour = (F.col(c) for c in base.columns)
    return (base.groupingSets([[time], [day, rider], [station, day, hour]], *base.columns)
            .agg(F.count(F.lit(1)).alias("trip_count"), F.grouping_id().alias("g"))
            .withColumn("level", F.when(F.col("g") == 0b01111, "hourly").when(F.col("g") == 0b10011, "daily")
                        .otherwise("station")).drop("g"))


def routes(trips: DataFrame) -> DataFrame:
    return trips.groupBy("start_station_name", "end_station_name").agg(F.count(F.lit(1)).alias("trip_count"))


def top_routes(trips: DataFrame, n: int = 200) -> DataFrame:
    """Busiest station pairs; ties by name."""
    return routes(trips).orderBy(F.desc("trip_count"), "start_station_name", "end_station_name").limit(n)


def station_quality(series: DataFrame, absolute: bool = False) -> DataFrame:
    """Volume, coverage, variation and the quality score of every station.

    ``absolute`` scores the size of net demand and does not limit the variation.
    """
    value = F.abs("net_demand") if absolute else F.col("pickups")
    stats = series.groupBy("station_name").agg(
        F.count(value).alias("data_points"), F.sum(value).alias("volume"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"), F.min("time").alias("first_time"), F.max("time").alias("last_time"))
    days = F.timestamp_diff("SECOND", F.col("first_time"), F.col("last_time")) / F.lit(86400.0)
    stats = (stats.withColumn("days_active", days)
             .withColumn("coverage", clip(F.col("data_points") / (F.col("days_active") * 24 + 1), 0.0, 1.0))
             .withColumn("cv", F.col("std") / (F.col("mean") + F.lit(1e-6))))
    cv = F.col("cv") if absolute else clip(F.col("cv"), 0.5, 3.0)
    return stats.withColumn("score", F.col("volume") * F.col("coverage") / (cv + 1))


def top_stations(quality: DataFrame, n: int) -> DataFrame:
    """The n best scores; stations without a score do not take part, ties go by name."""
    return quality.where("score is not null").orderBy(F.desc("score"), "station_name").limit(n)


def station_metadata(series: DataFrame, col: str = "pickups") -> DataFrame:
    return series.groupBy("station_name").agg(
        F.avg(col).alias("mean_demand"), F.coalesce(F.stddev_samp(col), F.lit(1.0)).alias("std_demand"),
        F.max(col).alias("max_demand"))


def daily_weather(hourly: DataFrame) -> DataFrame:
    """Mean temperature and rain sum per day; an hour that occurs several times counts once (smallest values)."""
    once = hourly.groupBy("time").agg(F.min(F.struct("temp", "prcp")).alias("w")).select("time", "w.*")
    return once.groupBy(F.col("time").cast("date").alias("date")).agg(F.avg("temp").alias("temp"), F.sum("prcp").alias("prcp"))


def demand_profile(series: DataFrame, col: str = "pickups") -> DataFrame:
    """Mean demand by hour, weekday and month from one pass (grouping sets)."""
    base = series.select(F.hour("time").alias("hour"), F.weekday("time").alias("dow"), F.month("time").alias("month"), col)
    hour, dow, month = F.col("hour"), F.col("dow"), F.col("month")
    return (base.groupingSets([[hour], [dow], [month]], hour, dow, month)
            .agg(F.avg(col).alias("mean_demand"), F.grouping_id().alias("g"))
            .select(F.when(F.col("g") == 0b011, "hour").when(F.col("g") == 0b101, "weekday").otherwise("month").alias("level"),
                    F.coalesce(hour, dow, month).alias("slot"), "mean_demand"))


def weekly_pattern(series: DataFrame) -> DataFrame:
    return (series.groupBy(day_name(F.col("time")).alias("day_name"), F.when(F.weekday("time") >= 5, 1).otherwise(0).alias("is_weekend"))
            .agg(F.avg("pickups").alias("pickups")))


def station_baselines(series: DataFrame, before: Column | None = None) -> DataFrame:
    """Per station, weekday and hour: the station's mean at that hour, on that weekday and its share of all pickups.

    ``before`` limits the rows the means may see, so that a later test period does not leak into them.
    """
    base = series.where(before) if before is not None else series
    base = base.select("station_name", F.hour("time").alias("hour"), F.weekday("time").alias("dow"), "pickups")
    cells = base.groupBy("station_name", "hour", "dow").agg(F.sum("pickups").alias("s"), F.count("pickups").alias("n"))
    # at most 168 cells per station: the two means come from the cells, not from the rows
    hourly = cells.groupBy("station_name", "hour").agg((F.sum("s") / F.sum("n")).alias("station_avg_hourly"))
    weekly = cells.groupBy("station_name", "dow").agg((F.sum("s") / F.sum("n")).alias("station_avg_dow"))
    total = base.agg(F.sum("pickups").alias("t")).scalar()
    popular = cells.groupBy("station_name").agg((F.sum("s") / total).alias("popularity"))
    return (cells.select("station_name", "hour", "dow").join(hourly, ["station_name", "hour"])
            .join(weekly, ["station_name", "dow"]).join(popular, "station_name"))


def profile(trips: DataFrame, approx: bool = False) -> DataFrame:
    """Rows, covered dates, nulls and distinct stations of a trip table in one pass."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    return trips.agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("started_at").alias("first_time"), F.max("started_at").alias("last_time"),
        F.datediff(F.max("started_at"), F.min("started_at")).alias("span_days"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in ("start_station_name", "end_station_name", "ended_at")],
        distinct("start_station_name").alias("n_start_stations"), distinct("end_station_name").alias("n_end_stations"))
