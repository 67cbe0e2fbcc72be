"""Top-k, orderings, deduplication and sampling with fixed tie rules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEKDAY_ORDER = {"Monday": 0, "Tuesday": 1, "Wednesday": 2, "Thursday": 3, "Friday": 4, "Saturday": 5, "Sunday": 6}
PRIORITY_ORDER = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def topk(df: DataFrame, by: str, n: int, key: list[str]) -> DataFrame:
    """The n largest; planned as one take-ordered step that keeps n rows per task."""
    return df.orderBy(F.desc(by), *key).limit(n)


def mapped_rank(col: Column, order: dict[str, int]) -> Column:
    """Position of a label in a fixed order; unknown labels come last."""
    out = F.lit(len(order))
    for label, pos in order.items():
        out = F.when(col == label, pos).otherwise(out)
    return out


def ordered(df: DataFrame, keys: list) -> DataFrame:
    return df.orderBy(*keys)


def top_by_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """Most frequent values of a column with their row counts."""
    return topk(df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")), "n_rows", n, [key])


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of every key in the given order.

    An aggregate, not a ranking window: each task keeps one row per key before the shuffle, so a key with very many
    copies costs no more than others.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.groupBy(*keys).agg(first).select(*keys, "r.*")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row of every key in the given order, also as an aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def tail_per_group(df: DataFrame, key: str, time: str, n: int) -> DataFrame:
    """Last n rows of every group; the ranking filter is applied within tasks before the shuffle (group limit)."""
    w = Window.partitionBy(key).orderBy(F.desc(time))
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def recent(df: DataFrame, time: str, days: int) -> DataFrame:
    """Rows of the last days before the latest time."""
    end = df.agg(F.max(time).alias("m")).scalar()
    return df.where(F.col(time) >= end - F.make_dt_interval(F.lit(days)))


def digest(key: list[str], seed: int = 42) -> Column:
    """Hexadecimal digest of seed and key; a plain function of the text, so any engine draws the same rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary"))


def in_share(key: list[str], share: float, seed: int = 42) -> Column:
    """Whether the first eight digits of the key's digest fall into the share."""
    return F.lit(True) if share >= 1 else F.substring(digest(key, seed), 1, 8) < F.lit(f"{math.ceil(share * 2**32):08x}")


def sample_fraction(df: DataFrame, key: list[str], fraction: float, seed: int = 42) -> DataFrame:
    """Share of the rows chosen by a digest of their key: repeatable whatever the partitioning, and without a shuffle."""
    return df.where(in_share(key, fraction, seed))


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """At most n rows in the order of their key's digest; every task keeps its first n only."""
    return df.orderBy(digest(key, seed), *key).limit(n)


def sample_station_dates(series: DataFrame, n_stations: int, dates: list[str], seed: int = 42) -> DataFrame:
    """Sampled stations paired with fixed dates of the four seasons."""
    stations = sample_rows(series.select("station_name").distinct(), ["station_name"], n_stations, seed)
    return stations.select("station_name", F.explode(F.array(*[F.lit(d).cast("date") for d in dates])).alias("date"))


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
