"""What several operators need: settings, bounded samples, bitmaps, connected components and summed statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.session import stage, stage_path  # noqa: F401  (the operators take both from here)

# Rows and bytes of a batch that a Python task holds at once; texts can be long, so few rows.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20
# The tasks that a bounded training sample is spread over, each of which sends one vector of statistics.
TRAIN_TASKS = 8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables, with the settings that the operators expect."""
    return prepared(spark).read.parquet(f"{folder}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    return spark


def bytes_of(column: pa.Array) -> list[bytes]:
    """The texts of a binary column as bytes; null is empty."""
    return [b"" if x is None else x for x in column.to_pylist()]


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, bound: int) -> DataFrame:
    """At most ``bound`` documents with a label, those of the lowest hash of their key; ``labels`` has the key and the label's columns.

    The labels are cut before they meet the texts, so the broadcast side has ``bound`` short rows at most.
    """
    few = labels.where(F.col(key).isNotNull()).dropDuplicates([key]).orderBy(F.xxhash64(key, F.lit(7)), key).limit(bound)
    return docs.join(F.broadcast(few), key)


def summed(frame: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray | None:
    """The sum over tasks of the vector that ``fn`` makes of a task's batches; the frame is a bounded sample in TRAIN_TASKS tasks at most."""
    def run(batches):
        yield pa.RecordBatch.from_pydict({"v": pa.array([fn(batches).astype("<f8").tobytes()], pa.binary())})

    parts = [np.frombuffer(r.v, "<f8") for r in frame.coalesce(TRAIN_TASKS).mapInArrow(run, "v binary").collect()]
    return np.sum(parts, axis=0) if parts else None


def descend(frame: DataFrame, gradient: Callable, start: np.ndarray, steps: int, rate: float, l2: float) -> np.ndarray:
    """Full-batch Adam: ``gradient(weights, batches)`` gives a task's summed gradient with the number of examples as last element."""
    w, m, v = start.astype(float), np.zeros_like(start, float), np.zeros_like(start, float)
    for t in range(1, steps + 1):
        total = summed(frame, lambda batches, w=w: gradient(w, batches))
        if total is None or total[-1] == 0:
            return w
        g = total[:-1] / total[-1] + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def bitmap(frame: DataFrame, column: str, bits: int) -> np.ndarray:
    """A set of ``2**bits`` bits as bytes, with the bits of the column's low bits set: of fixed size, whatever the number of rows.

    The rows of the result have 4 KB each, so the driver gets ``2**(bits - 3)`` bytes at most.
    """
    pos = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")
    parts = (frame.groupBy(F.bitmap_bucket_number(pos).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(pos)).alias("bits"))).collect()
    out = np.zeros((1 << bits) // 8 + 4096, np.uint8)
    for r in parts:
        at = (r.part - 1) * 4096 if r.part > 0 else len(out) - 4096
        out[at:at + 4096] |= np.frombuffer(bytes(r.bits), np.uint8)
    # Spark counts positions from 1 within a bucket for positive values and keeps 0 in bucket 0
    return out


def in_bitmap(words: np.ndarray, tokens: np.ndarray, bits: int) -> np.ndarray:
    """Which 64-bit tokens have their bit set in what ``bitmap`` made."""
    pos = tokens.astype(np.int64) & ((1 << bits) - 1)
    bucket = np.where(pos > 0, 1 + (pos - 1) // 32768, 0)
    at = np.where(pos > 0, (pos - 1) % 32768, 0)
    start = np.where(bucket > 0, (bucket - 1) * 4096, len(words) - 4096)
    return (words[start + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1


def probably_in(key: Column, ids: DataFrame, column: str, bits: int) -> Column:
    """Whether the whole number ``key`` is, by its bit in a bitmap, one of ``ids``: true for all of them and few others, false for null.

    Only the key goes to a Python worker, so rows with long texts are told apart without a shuffle; a join decides on those that are left.
    """
    share = ids.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64(F.col(column).cast("long")).alias("h")), "h", bits))

    @F.arrow_udf("boolean")
    def probe(h: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(share.value, h.to_numpy(zero_copy_only=False).astype(np.int64), bits))

    return key.isNotNull() & probe(F.xxhash64(key.cast("long")))


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of ``edges`` (a, b): (node, component), the component being its smallest node. Nodes without an edge aren't returned.

    Alternating stars: each round links neighbours to the smallest node they see, which is an aggregate and an equality join, so a
    node with very many edges is folded before the shuffle or split by adaptive execution. Rounds are about the logarithm of the
    longest path; each is a table in the shared folder.
    """
    e = stage(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = stage(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), f"{name}-large")
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = stage(e.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                  .select("e.a", "e.b").where("a <> b").distinct(), f"{name}-small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
