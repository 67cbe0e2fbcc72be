"""Writers: staged tables, station-clustered Parquet, CSV and JSON."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_station(df: DataFrame, path: str, key: str = "station_name", time: str = "time", files: int | None = None) -> None:
    """Parquet clustered by station: range-partitioned by (station, time) and sorted, so a station filter prunes.

    Range partitioning splits a hot station over several files instead of sending it to one task.
    """
    ranged = df.repartitionByRange(files, key, time) if files else df.repartitionByRange(key, time)
    ranged.sortWithinPartitions(key, time).write.parquet(path)


def write_buckets(df: DataFrame, path: str, key: str = "station_name", time: str = "time", buckets: int = 64) -> None:
    """Parquet in one file per bucket of the key's hash, sorted by key and time; ``<path>-about`` says how, for ``open_buckets``.

    An equality on the key then reads one bucket, and of it the row groups that hold the key. A key's rows are one station's hours.
    """
    spark, name = df.sparkSession, f"written_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key, time).option("path", path).saveAsTable(name)
    spark.sql(f"drop table {name}")  # the files stay
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    spark.range(1).select(F.lit(columns).alias("columns"), F.lit(key).alias("key"), F.lit(time).alias("time"), F.lit(buckets).alias("buckets")).write.json(f"{path}-about")


def open_buckets(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_buckets`` wrote, with its buckets known to the optimizer."""
    about = spark.read.json(f"{path}-about").first()
    name = f"buckets_{hashlib.md5(path.encode()).hexdigest()}"
    spark.sql(f"create table if not exists {name} ({about['columns']}) using parquet clustered by (`{about['key']}`) sorted by (`{about['key']}`, `{about['time']}`) "
              f"into {about['buckets']} buckets location '{path}'")
    return spark.table(name)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with header; times keep their microseconds."""
    out = df.select(*columns) if columns else df
    out.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One record per line, in parallel."""
    df.write.json(path)


def records(df: DataFrame, out: str = "record") -> DataFrame:
    """Each row as a JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))


def keyed_records(df: DataFrame, key: str) -> DataFrame:
    """Dictionary form, one entry per line: {key: {other columns}}. A line per key keeps it parallel."""
    rest = [c for c in df.columns if c != key]
    return df.select(F.to_json(F.create_map(F.col(key).cast("string"), F.struct(*rest))).alias("record"))
