"""Streaming twins of the live parts: feed ingest, latest status, action board, windowed demand, duplicates, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.functions.cleaning import valid_station
from dockflow.operators.ranking import latest
from dockflow.plans.operations import action_board, rebalancing_actions, station_state
from dockflow.session import stage_path
from dockflow.sources.files import exists

REFRESH = "60 seconds"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Landed files as a stream; the path is a folder or a glob."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def event_time(df: DataFrame, col: str, delay: str) -> DataFrame:
    """Watermark on a column without zone, read in UTC."""
    return df.withColumn(col, F.col(col).cast("timestamp")).withWatermark(col, delay)


def hourly_pickups(trips: DataFrame, delay: str = "1 hour", col: str = "started_at") -> DataFrame:
    """Pickups per station and closed hour."""
    return (event_time(trips.where(valid_station(F.col("start_station_name"))), col, delay)
            .groupBy(F.window(col, "1 hour").alias("w"), "start_station_name").agg(F.count(F.lit(1)).alias("pickups"))
            .select(F.col("start_station_name").alias("station_name"), F.col("w.start").alias("time"), "pickups"))


def sliding_demand(trips: DataFrame, length: str = "24 hours", hop: str = "1 hour", delay: str = "1 hour", col: str = "started_at") -> DataFrame:
    """System demand of the last day, every hour."""
    return (event_time(trips, col, delay).groupBy(F.window(col, length, hop).alias("w")).agg(F.count(F.lit(1)).alias("pickups"))
            .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "pickups"))


def distinct_trips(trips: DataFrame, delay: str = "1 hour", key: str = "trip_id", col: str = "started_at") -> DataFrame:
    """Each trip once, as long as its copies arrive within the delay; state of older trips is dropped."""
    return event_time(trips, col, delay).dropDuplicatesWithinWatermark([key])


def enriched(trips: DataFrame, stations: DataFrame, weather: DataFrame) -> DataFrame:
    """Trips with station position and the weather of their hour (stream-static joins)."""
    hour = F.date_trunc("hour", F.col("started_at")).cast("timestamp_ntz")
    s = stations.select(F.col("station_name").alias("start_station_name"), "lat", "lon")
    return trips.withColumn("time", hour).join(s, "start_station_name", "left").join(weather, "time", "left")


def land(df: DataFrame, batch: Column, batches: int, root: str, files: int = 2) -> str:
    """Write the rows of each batch as ``files`` files, one batch after the other, so a stream with that many files per trigger meets them in order."""
    rows = df.withColumn("_batch", batch)
    for i in range(batches):
        rows.where(F.col("_batch") == i).drop("_batch").repartition(files).write.parquet(f"{root}/{i:06d}")
    return f"{root}/*"


def run_to_table(df: DataFrame, name: str, mode: str = "append", available_now: bool = True, path: str | None = None) -> str:
    """Write a stream to Parquet under the staging folder; returns the path. Waits for the end in available-now mode.

    With the ``path`` of an earlier run the stream goes on where that ended, with its state.
    """
    spark = df.sparkSession
    path = path or stage_path(spark, name)
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}-state").option("path", path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=REFRESH)
    query = writer.start()
    if available_now:
        query.awaitTermination()
    return path


class Versions:
    """Numbered tables below a folder, one for each micro-batch, and a list of those that are complete.

    A batch that is repeated after a failure replaces its own table. It is listed once it is written, so readers never meet half a table;
    the list is a table itself, a row for each number, and needs no access to the file system but Spark's own.
    """

    def __init__(self, root: str):
        self.root = root

    def write(self, df: DataFrame, number: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/v{number}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.root}/v{number}")

    def publish(self, spark: SparkSession, number: int, note: str | None = None, good: bool = True) -> None:
        one = spark.range(1).select(F.lit(number).cast("long").alias("number"), F.lit(good).alias("good"), F.lit(note).cast("string").alias("note"))
        one.write.mode("overwrite").parquet(f"{self.root}/list/n{number}")

    def listed(self, spark: SparkSession) -> DataFrame:
        if not exists(spark, f"{self.root}/list/*"):
            return spark.createDataFrame([], "number long, good boolean, note string")
        return spark.read.parquet(f"{self.root}/list/*")

    def numbers(self, spark: SparkSession, before: int | None = None) -> list[int]:
        """Numbers of the complete tables, ascending."""
        rows = self.listed(spark).where("good")
        return sorted(r.number for r in (rows if before is None else rows.where(F.col("number") < before)).select("number").collect())

    def read(self, spark: SparkSession, numbers: list[int]) -> DataFrame:
        return spark.read.parquet(*[f"{self.root}/v{n}" for n in numbers])


class LatestStatus:
    """Keeps the latest status per station in the stream's state and publishes the action board after each micro-batch.

    The state is an aggregate with one row per station. A batch hands on only stations that changed, and only these are written; the
    current table is the newest row of each station over a folded table and the batches since. Every ``fold`` batches these are
    folded, so a reader meets that many small tables at most. A restarted stream finds state and tables under the same ``root``.
    """

    def __init__(self, spark: SparkSession, info: DataFrame, order: list[str], root: str | None = None, fold: int = 32):
        self.root = root or stage_path(spark, "latest-status")
        self.info, self.order, self.fold = info, order, fold
        self.changes, self.folded, self.boards = (Versions(f"{self.root}/{x}") for x in ("changes", "folded", "boards"))

    def changed(self, status: DataFrame) -> DataFrame:
        """The stream's aggregate: the newest row of each station."""
        rest = [c for c in status.columns if c not in (*self.order, "station_id")]
        newest = status.groupBy("station_id").agg(F.max(F.struct(*self.order, *rest)).alias("s"))
        return newest.select(*[F.col("station_id") if c == "station_id" else F.col(f"s.{c}").alias(c) for c in status.columns])

    def _current(self, spark: SparkSession, upto: int | None = None) -> DataFrame:
        before = None if upto is None else upto + 1
        base = self.folded.numbers(spark, before)[-1:]
        parts = [self.changes.read(spark, since)] if (since := [n for n in self.changes.numbers(spark, before) if not base or n > base[0]]) else []
        if base:
            parts.append(self.folded.read(spark, base))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return latest(out, ["station_id"], self.order)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        self.changes.write(batch, batch_id)
        self.changes.publish(spark, batch_id)
        if batch_id % self.fold == self.fold - 1:
            self.folded.write(self._current(spark, batch_id), batch_id)
            self.folded.publish(spark, batch_id)
        self.boards.write(action_board(rebalancing_actions(station_state(self.info, self._current(spark, batch_id), self.order))), batch_id)
        self.boards.publish(spark, batch_id)

    def table(self, spark: SparkSession) -> DataFrame:
        return self._current(spark)

    def board(self, spark: SparkSession) -> DataFrame:
        return self.boards.read(spark, self.boards.numbers(spark)[-1:])

    def run(self, status: DataFrame, available_now: bool = True):
        """Start the stream: at most one refresh per minute, or all landed files once."""
        writer = self.changed(status).writeStream.outputMode("update").foreachBatch(self).option("checkpointLocation", f"{self.root}/state")
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=REFRESH)
        query = writer.start()
        if available_now:
            query.awaitTermination()
        return query


class FeedTable:
    """The last good snapshot of a feed: each micro-batch of landed files is one snapshot, read as lines of JSON.

    A snapshot is written first and checked as written: no broken line, a key in every row, no key twice, at least ``least`` rows. Only then
    it becomes the version that is served; otherwise the version before it stays and the reason is listed. Readers follow the list, so
    they see whole snapshots only, old ones at worst.
    """

    BROKEN = "_broken"

    def __init__(self, spark: SparkSession, schema: T.StructType, key: str, root: str | None = None, least: int = 1):
        self.schema, self.key, self.least = schema, key, least
        self.root = root or stage_path(spark, "feed")
        self.versions = Versions(f"{self.root}/snapshots")

    def stream(self, spark: SparkSession, path: str, files: int) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(self.BROKEN, T.StringType())])
        reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", self.BROKEN).option("maxFilesPerTrigger", files)
        return reader.json(path)

    def fault(self, snapshot: DataFrame) -> str | None:
        """Why a written snapshot can't be served."""
        n = snapshot.agg(F.count("*").alias("rows"), F.count(self.BROKEN).alias("broken"), F.count(self.key).alias("keys"), F.count_distinct(self.key).alias("distinct")).first()
        if n["broken"]:
            return f"{n['broken']} broken lines"
        if n["rows"] < self.least:
            return f"{n['rows']} rows"
        return "rows without a key" if n["keys"] < n["rows"] else "a key twice" if n["distinct"] < n["keys"] else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        written = self.versions.write(batch, batch_id)
        why = self.fault(written)
        self.versions.publish(batch.sparkSession, batch_id, why, why is None)

    def served(self, spark: SparkSession) -> DataFrame | None:
        """The last good snapshot with its version; none before the first."""
        good = self.versions.numbers(spark)
        return self.versions.read(spark, good[-1:]).drop(self.BROKEN).withColumn("version", F.lit(good[-1])) if good else None

    def run(self, spark: SparkSession, path: str, files: int = 1, available_now: bool = True):
        """Follow the landed files: one snapshot a trigger, a trigger each REFRESH, or all that have landed."""
        writer = self.stream(spark, path, files).writeStream.foreachBatch(self).option("checkpointLocation", f"{self.root}/state")
        query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=REFRESH)).start()
        if available_now:
            query.awaitTermination()
        return query
