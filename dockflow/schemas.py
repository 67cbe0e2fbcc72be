"""Explicit schemas of the inputs, and the ordered feature list of the demand model."""

from pyspark.sql import types as T

TRIPS = T.StructType([
    T.StructField("trip_id", T.LongType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("ended_at", T.TimestampNTZType()),
    T.StructField("start_station_name", T.StringType()),
    T.StructField("end_station_name", T.StringType()),
    T.StructField("start_lat", T.DoubleType()),
    T.StructField("start_lng", T.DoubleType()),
    T.StructField("end_lat", T.DoubleType()),
    T.StructField("end_lng", T.DoubleType()),
    T.StructField("member_casual", T.StringType()),
    T.StructField("rideable_type", T.StringType()),
])

FEED_INFORMATION = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("stations", T.ArrayType(T.StructType([
            T.StructField("station_id", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("lat", T.DoubleType()),
            T.StructField("lon", T.DoubleType()),
            T.StructField("capacity", T.LongType()),
        ]))),
    ])),
])

FEED_STATUS = T.StructType([
    T.StructField("data", T.StructType([
        T.StructField("stations", T.ArrayType(T.StructType([
            T.StructField("station_id", T.StringType()),
            T.StructField("num_bikes_available", T.LongType()),
            T.StructField("num_ebikes_available", T.LongType()),
            T.StructField("num_docks_available", T.LongType()),
            T.StructField("is_renting", T.LongType()),
            T.StructField("is_returning", T.LongType()),
            T.StructField("last_reported", T.LongType()),
        ]))),
    ])),
])

# Lags (rows back) and rolling windows (rows) of the demand model.
LAGS = [1, 2, 3, 6, 12, 24, 48, 168]
ROLLING = [4, 12, 24, 168]
EMA_SPAN = 24

WEATHER_FEATURES = ["temp", "prcp", "wspd"]
CALENDAR_FEATURES = [
    "is_holiday", "day_of_week", "is_weekend", "days_to_holiday", "days_since_holiday",
    "hour", "day", "month", "year", "quarter",
    "hour_sin", "hour_cos", "month_sin", "month_cos", "day_sin", "day_cos",
    "is_morning_rush", "is_evening_rush", "is_rush_hour", "is_business_hours",
    "time_of_day", "season", "week_of_year", "is_month_start", "is_month_end", "days_since_epoch",
]
LAG_FEATURES = [f"lag_{k}h" for k in LAGS]
ROLLING_FEATURES = [f"roll_{stat}_{w}h" for w in ROLLING for stat in ("mean", "std", "min", "max")]
FEATURES = WEATHER_FEATURES + CALENDAR_FEATURES + LAG_FEATURES + ROLLING_FEATURES + [f"ema_{EMA_SPAN}h"]
