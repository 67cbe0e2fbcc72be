"""Session set-up and shared staging storage. Joins are left to adaptive execution, which broadcasts by measured bytes."""

from __future__ import annotations

import tempfile
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_local_stage: str | None = None
_run: str | None = None


def get_spark(app: str = "dockflow", master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """Build (or fetch) a session with the settings the operators expect; ``memory`` is the driver's, for local runs."""
    builder = SparkSession.builder.appName(app)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return prepare(builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings: UTC, adaptive execution, runtime skew handling."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    # window work per row is heavy: small shuffles keep enough partitions to use all cores (no effect on large ones)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
    # a generated method of more bytes is never compiled by the JVM: rows with all features would be interpreted
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def stage_root(spark: SparkSession) -> str:
    """Folder for staged tables: the cluster's shared checkpoint folder, a temporary one only in local runs."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _local_stage
    if _local_stage is None:
        _local_stage = tempfile.mkdtemp(prefix="dockflow-stage-")
    return _local_stage


@contextmanager
def staging(spark: SparkSession) -> Iterator[str]:
    """A folder of its own below the staging folder for all tables that are staged inside the block; it is removed at its end.

    Results that read staged tables have to be written or collected before that. Files of a store that only Spark reaches stay, with a warning.
    """
    global _run
    outer, _run = _run, f"run-{uuid.uuid4().hex}"
    folder = f"{stage_root(spark)}/{_run}"
    try:
        yield folder
    finally:
        _run = outer
        try:
            store, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
            if store.get_file_info(path).type == fs.FileType.Directory:
                store.delete_dir(path)
        except (OSError, ValueError) as e:
            warnings.warn(f"{folder} stays: {e}", stacklevel=2)


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the staging folder, or the folder of the ``staging`` block; nothing is ever overwritten."""
    return "/".join([stage_root(spark), *([_run] if _run else []), f"{name}-{uuid.uuid4().hex}"])


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a stage to shared storage and read it back, which cuts the lineage and survives lost executors."""
    path = stage_path(df.sparkSession, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
