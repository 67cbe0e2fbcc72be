"""Readers of trips, weather, assets and live feeds from files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dockflow.schemas import FEED_INFORMATION, FEED_STATUS

NTZ_FORMAT = "yyyy-MM-dd[ ]['T']HH:mm[:ss][.SSSSSS][.SSS]"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob matches anything on its file system; nothing is read."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists: full table, else the recent slice, else the older place."""
    return next((p for p in paths if exists(spark, p)), None)


def read_csv(spark: SparkSession, paths: list[str], schema: T.StructType, corrupt: str | None = None) -> DataFrame | None:
    """CSV with header from the first existing path; None if no path exists. Values that can't be read are null; with ``corrupt`` that column
    has the text of each line that holds some, so that nothing is lost silently."""
    path = first_existing(spark, paths)
    if path is None:
        return None
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("timestampNTZFormat", NTZ_FORMAT)
    if corrupt is None:
        return reader.schema(schema).csv(path)
    return reader.option("columnNameOfCorruptRecord", corrupt).schema(T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan; only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_station(spark: SparkSession, path: str, name, key: str = "station_name") -> DataFrame:
    """Rows of one station; the equality reaches the scan, and tables sorted by station skip row groups."""
    return spark.read.parquet(path).where(F.col(key) == F.lit(name))


def trip_file_headers(spark: SparkSession, globs: list[str], schema: T.StructType) -> DataFrame:
    """(path, header, skipped) of every file that a glob matches: its first line, and why it can't be read, if so; empty files have no row.

    Only the first block of each file is looked at, and its lines are folded where they are read.
    """
    found = [g for g in globs if exists(spark, g)]
    if not found:
        return spark.createDataFrame([], "path string, header string, skipped string")
    files = spark.read.format("binaryFile").load(found).select("path")
    lines = (spark.read.text(found).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
             .where("start = 0").withColumn("line", F.monotonically_increasing_id()))
    first = lines.groupBy(F.regexp_replace("path", "^file:/+", "file:/").alias("path")).agg(F.min_by("value", "line").alias("header"))
    known = F.arrays_overlap(F.split(F.regexp_replace("header", '"', ""), ","), F.array(*[F.lit(f.name) for f in schema.fields]))
    why = F.when(F.coalesce(known, F.lit(False)), None).otherwise("no known column in the header")
    return files.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/")).join(first, "path", "left").select("path", "header", why.alias("skipped"))


def read_trip_files(spark: SparkSession, globs: list[str], schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """All CSV files of several globs; globs without a file are left out, and so are the files that ``trip_file_headers`` marks as skipped.

    Columns are matched by name in each file, so files of one glob may order or lack columns: there is one scan for each
    distinct header. Malformed lines give nulls; with ``corrupt`` that column has their text.
    """
    by_header: dict[str, list[str]] = {}
    for r in trip_file_headers(spark, globs, schema).where("skipped is null").collect():  # one short row per file
        by_header.setdefault(r.header, []).append(r.path)
    wanted = [*schema.fields, *([T.StructField(corrupt, T.StringType())] if corrupt else [])]
    known = {f.name: f for f in schema.fields}
    out = spark.createDataFrame([], T.StructType(wanted))
    for header in sorted(by_header):
        paths = by_header[header]
        names = spark.read.option("header", True).csv(paths[0]).columns
        as_found = [known.get(n, T.StructField(n, T.StringType())) for n in names] + ([T.StructField(corrupt, T.StringType())] if corrupt else [])
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False).option("timestampNTZFormat", NTZ_FORMAT)
        if corrupt:
            reader = reader.option("columnNameOfCorruptRecord", corrupt)
        part = reader.schema(T.StructType(as_found)).csv(paths)
        out = out.unionByName(part.select(*[F.col(f.name) if f.name in (*names, corrupt) else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]))
    return out


def read_json_asset(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = False) -> DataFrame | None:
    """Records of a JSON asset: an array per file, or one record per line, which can be split. None if it is absent."""
    if not exists(spark, path):
        return None
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def explode_feed(feed: DataFrame) -> DataFrame:
    return feed.select(F.explode("data.stations").alias("s")).select("s.*")


def read_feed(spark: SparkSession, information: str, status: str) -> tuple[DataFrame, DataFrame]:
    """Station information and status snapshots from folders of feed files, one row per station and file."""
    info = explode_feed(spark.read.option("multiLine", True).schema(FEED_INFORMATION).json(information))
    state = explode_feed(spark.read.option("multiLine", True).schema(FEED_STATUS).json(status))
    return info, state


def read_weather(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Hourly weather delivered in several chunks, united by column name; an hour delivered twice is kept once."""
    out = None
    for p in paths:
        part = spark.read.parquet(p)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    rest = [c for c in out.columns if c != "time"]
    return out.groupBy("time").agg(F.min(F.struct(*rest)).alias("w")).select("time", "w.*")


def json_fields(col, schema: str):
    """Typed access to a JSON text column."""
    return F.from_json(col, schema)
