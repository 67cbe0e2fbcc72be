"""Calendar columns, the federal holiday table built from its rules, and the hour dimension."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Federal holidays. (month, day, first year) and (month, weekday, n-th, first year); -1 is the last.
FIXED_HOLIDAYS = [(1, 1, 1870), (6, 19, 2021), (7, 4, 1870), (11, 11, 1938), (12, 25, 1870)]
FLOATING_HOLIDAYS = [
    (1, "MON", 3, 1986), (2, "MON", 3, 1971), (5, "MON", -1, 1971),
    (9, "MON", 1, 1894), (10, "MON", 2, 1971), (11, "THU", 4, 1942),
]
HOLIDAY_CAP = 30
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def day_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")


def day_of_week(ts: Column) -> Column:
    """Monday is 0, Sunday is 6."""
    return F.weekday(ts)


def is_weekend(ts: Column) -> Column:
    return F.when(F.weekday(ts) >= 5, 1).otherwise(0)


def cycle(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position within a period."""
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def time_of_day(hour: Column, variant: str = "train") -> Column:
    """Part of the day: ``train`` 1..4, ``serve`` 0..3, ``bins`` 0..3 with right-closed bins."""
    if variant == "train":
        return (F.when((hour >= 5) & (hour < 12), 1).when((hour >= 12) & (hour < 17), 2)
                .when((hour >= 17) & (hour < 21), 3).otherwise(4))
    if variant == "serve":
        return F.when(hour < 6, 0).when(hour < 12, 1).when(hour < 18, 2).otherwise(3)
    if variant == "bins":
        return F.when(hour <= 6, 0).when(hour <= 12, 1).when(hour <= 18, 2).otherwise(3)
    raise ValueError(f"unknown variant {variant}")


def season(month: Column, first: int = 1) -> Column:
    """Winter (from December) to autumn, counted from ``first``."""
    return F.floor((month % 12) / 3).cast("int") + F.lit(first)


def month_edges(ts: Column, variant: str = "near") -> tuple[Column, Column]:
    """Start and end of month flags: ``near`` is day <= 3 and day >= 28, ``exact`` is the first and last day."""
    day = F.day(ts)
    if variant == "near":
        return F.when(day <= 3, 1).otherwise(0), F.when(day >= 28, 1).otherwise(0)
    last = F.day(F.last_day(ts.cast("date")))
    return F.when(day == 1, 1).otherwise(0), F.when(day == last, 1).otherwise(0)


def days_since_epoch(ts: Column, variant: str = "fraction") -> Column:
    """Days with fraction from 2020-01-01, or ``whole`` days from 2019-01-01."""
    if variant == "fraction":
        start = F.lit("2020-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("SECOND", start, ts) / F.lit(86400.0)
    return F.datediff(ts.cast("date"), F.lit("2019-01-01").cast("date"))


def hour_columns(ts: Column) -> dict[str, Column]:
    """Every calendar feature that needs nothing but the hour."""
    hour, day, month, dow = F.hour(ts), F.day(ts), F.month(ts), F.weekday(ts)
    hour_sin, hour_cos = cycle(hour, 24)
    month_sin, month_cos = cycle(month, 12)
    day_sin, day_cos = cycle(day, 31)
    starts, ends = month_edges(ts)
    morning, evening = hour.between(7, 9), hour.between(17, 19)
    flag = lambda cond: F.when(cond, 1).otherwise(0)
    return {
        "day_of_week": dow, "is_weekend": flag(dow >= 5),
        "hour": hour, "day": day, "month": month, "year": F.year(ts), "quarter": F.quarter(ts),
        "hour_sin": hour_sin, "hour_cos": hour_cos, "month_sin": month_sin, "month_cos": month_cos,
        "day_sin": day_sin, "day_cos": day_cos,
        "is_morning_rush": flag(morning), "is_evening_rush": flag(evening), "is_rush_hour": flag(morning | evening),
        "is_business_hours": flag(hour.between(9, 17) & (dow < 5)),
        "time_of_day": time_of_day(hour), "season": season(month), "week_of_year": F.weekofyear(ts),
        "is_month_start": starts, "is_month_end": ends, "days_since_epoch": days_since_epoch(ts),
    }


def holiday_table(spark: SparkSession, first_year: int, last_year: int, extra: DataFrame | None = None) -> DataFrame:
    """Holidays of the years with their observed weekdays; ``extra`` adds dates of other calendars."""
    year = F.col("id").cast("int")
    days = []
    for month, day, since in FIXED_HOLIDAYS:
        date = F.make_date(year, F.lit(month), F.lit(day))
        observed = (F.when(F.weekday(date) == 5, F.date_sub(date, 1)).when(F.weekday(date) == 6, F.date_add(date, 1)))
        days += [F.when(year >= since, date), F.when(year >= since, observed)]
    for month, weekday, nth, since in FLOATING_HOLIDAYS:
        if nth > 0:
            date = F.date_add(F.next_day(F.date_sub(F.make_date(year, F.lit(month), F.lit(1)), 1), weekday), 7 * (nth - 1))
        else:
            date = F.next_day(F.date_sub(F.last_day(F.make_date(year, F.lit(month), F.lit(1))), 7), weekday)
        days.append(F.when(year >= since, date))
    out = spark.range(first_year, last_year + 1).select(F.explode(F.array(*days)).alias("date")).where("date is not null")
    if extra is not None:
        out = out.unionByName(extra.select(F.col("date").cast("date")))
    return out.distinct()


def holiday_proximity(days: DataFrame, holidays: DataFrame, none: int = HOLIDAY_CAP, cap: int | None = HOLIDAY_CAP) -> DataFrame:
    """Per calendar day: is_holiday, days to the next and since the last holiday (both strict).

    Both inputs are calendars of days, so the ordered window holds at most a few rows per day of the covered years;
    it never sees facts.
    """
    both = (days.select("date", F.lit(1).alias("wanted"), F.lit(None).cast("date").alias("h"))
            .unionByName(holidays.select("date", F.lit(0).alias("wanted"), F.col("date").alias("h")))
            .groupBy("date").agg(F.max("wanted").alias("wanted"), F.max("h").alias("h"))
            .withColumn("n", F.unix_date("date")))
    before = Window.orderBy("n").rangeBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(F.desc("n")).rangeBetween(Window.unboundedPreceding, -1)
    nxt, last = F.min("h").over(after), F.max("h").over(before)
    bound = (lambda c: F.least(c, F.lit(cap))) if cap is not None else (lambda c: c)
    return (both.withColumn("nxt", nxt).withColumn("last", last).where("wanted = 1")
            .select("date", F.when(F.col("h").isNotNull(), 1).otherwise(0).alias("is_holiday"),
                    bound(F.coalesce(F.datediff("nxt", "date"), F.lit(none))).alias("days_to_holiday"),
                    bound(F.coalesce(F.datediff("date", "last"), F.lit(none))).alias("days_since_holiday")))


def hour_dimension(hours: DataFrame, holidays: DataFrame) -> DataFrame:
    """One row per hour with all calendar features.

    The features are computed once per hour, not once per station and hour; facts take them with one join on ``time``.
    """
    days = hours.select(F.col("time").cast("date").alias("date")).distinct()
    near = holiday_proximity(days, holidays)
    return (hours.select("time", *[c.alias(n) for n, c in hour_columns(F.col("time")).items()],
                         F.col("time").cast("date").alias("date"))
            .join(near, "date", "left").drop("date"))
