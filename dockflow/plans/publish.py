"""Writes the tables that serving reads: history, recent slice, station metadata, station list and model summary."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.operators.ranking import recent
from dockflow.operators.rollups import station_metadata
from dockflow.session import stage
from dockflow.sources.sinks import open_buckets, write_buckets, write_by_station, write_json

HISTORY_COLUMNS = ["station_name", "time", "pickups", "dropoffs", "net_demand", "temp", "prcp", "wspd", "is_holiday", "is_weekend",
                   "hour_sin", "hour_cos", "month_sin", "month_cos"]
RECENT_DAYS = 60
BUCKET_ROWS = 1 << 20  # of the history
RECENT_COLUMNS = ["station_name", "time", "pickups", "temp", "prcp", "wspd"]


def publish(features: DataFrame, quality: DataFrame, metrics: DataFrame, path: str, recent_days: int = RECENT_DAYS) -> dict[str, str]:
    """Write all published tables below ``path`` and return their places.

    Only the columns of the history are staged, so features that nothing published reads are neither computed nor written. The history has
    64 buckets, and more of them if these would hold more than BUCKET_ROWS rows: a task sorts one bucket.
    """
    places = {n: f"{path}/{n}" for n in ("history", "recent", "station_metadata", "top_stations", "model_summary")}
    rows = stage(features.select(*HISTORY_COLUMNS), "history-rows")
    write_buckets(rows, places["history"], buckets=max(64, math.ceil(rows.count() / BUCKET_ROWS)))
    history = open_buckets(features.sparkSession, places["history"])
    write_by_station(recent(history, "time", recent_days).select(*RECENT_COLUMNS), places["recent"])
    station_metadata(history).write.parquet(places["station_metadata"])
    quality.select("station_name", "score").write.parquet(places["top_stations"])
    write_json(metrics, places["model_summary"])
    return places


def published_sizes(spark, places: dict[str, str]) -> DataFrame:
    """Rows of every published table."""
    out = None
    for name, place in places.items():
        df = spark.read.json(place) if name == "model_summary" else spark.read.parquet(place)
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
