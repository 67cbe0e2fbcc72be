"""Scaling, chronological splits and time-series folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.operators.quantiles import aggregate, attach, exact_quantiles, scalar_struct
from dockflow.session import stage


def fit_standard(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and population deviation per column (0 becomes 1) as one row; partial aggregates make it incremental."""
    aggs = []
    for c in cols:
        std = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(std > 0, std).otherwise(1.0).alias(f"{c}_scale")]
    return aggregate(df, aggs)


def apply_standard(df: DataFrame, cols: list[str], fitted: DataFrame) -> DataFrame:
    scaled = {c: (F.col(c) - F.col(f"_s.{c}_mean")) / F.col(f"_s.{c}_scale") for c in cols}
    return attach(df, fitted).select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def invert_standard(col: Column, fitted: DataFrame, name: str, floor: float | None = 0.0) -> Column:
    """Back to the original scale, limited from below."""
    m = scalar_struct(fitted)
    value = col * m.getField(f"{name}_scale") + m.getField(f"{name}_mean")
    return value if floor is None else F.greatest(value, F.lit(floor))


def merge_standard(parts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Combine chunk statistics (n, mean, m2) into one mean and population deviation."""
    base = parts.groupBy(*group) if group else parts.groupBy()
    total, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    second = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) / total - mean * mean
    return base.agg(total.alias("n"), mean.alias("mean"), F.sqrt(F.greatest(second, F.lit(0.0))).alias("std"))


def scale_minmax(df: DataFrame, col: str, low: float = 0.0, high: float = 1.0, out: str | None = None) -> DataFrame:
    ends = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    unit = (F.col(col) - lo) / F.when(hi > lo, hi - lo).otherwise(1.0)
    return attach(df, ends).withColumn(out or col, unit * (high - low) + low).drop("_s")


def scale_robust(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Distance from the median in interquartile ranges."""
    q = exact_quantiles(df, {"q1": (col, 0.25), "q2": (col, 0.5), "q3": (col, 0.75)})
    iqr = F.col("_s.q3") - F.col("_s.q1")
    return attach(df, q).withColumn(out or col, (F.col(col) - F.col("_s.q2")) / F.when(iqr > 0, iqr).otherwise(1.0)).drop("_s")


def row_cuts(df: DataFrame, cuts: dict[str, Column], time: str = "time", key: str = "station_name") -> DataFrame:
    """For positions in the order (time, key): the row that sits there, as one row (cut, time, key) each.

    Row counts per hour are summed up over the hours, which finds the hour of each position; only the rows of those few
    hours are ranked. ``cuts`` maps a name to a position expression over the total ``n``.
    """
    hours = df.groupBy(time).agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)  # one row per hour of the period
    upto = hours.select(time, (F.sum("c").over(w)).alias("upto"), "c", df.agg(F.count(F.lit(1)).alias("n")).scalar().alias("n"))
    marks = F.explode(F.array(*[F.struct(F.lit(k).alias("cut"), v.cast("long").alias("pos")) for k, v in cuts.items()]))
    at = (upto.select("*", marks.alias("m")).where("m.pos > upto - c and m.pos <= upto")
          .select(time, F.col("m.cut").alias("cut"), (F.col("m.pos") - F.col("upto") + F.col("c")).alias("rank")))
    # at most one row per cut: the fact side is filtered by a broadcast of that handful of rows
    ranked = df.select(time, key).join(F.broadcast(at), time)
    rn = F.row_number().over(Window.partitionBy("cut").orderBy(key))
    return ranked.withColumn("rn", rn).where("rn = rank").select("cut", time, key)


def time_split(df: DataFrame, share: float = 0.8, time: str = "time", key: str = "station_name") -> DataFrame:
    """Flag the first int(share * n) rows in the order (time, key) as training rows; the facts are not shuffled."""
    cut = row_cuts(df, {"split": F.floor(F.col("n") * share)}, time, key)
    last = stage(cut.agg(F.max(F.struct(F.col(time).alias("t"), F.col(key).alias("k"))).alias("last")), "split-cut").scalar()  # found once, for all that read the rows
    here = F.struct(F.col(time).alias("t"), F.col(key).alias("k"))
    return df.withColumn("is_train", F.when(here <= last, 1).otherwise(0))


def time_folds(df: DataFrame, k: int = 3, time: str = "time", key: str = "station_name") -> DataFrame:
    """Expanding folds: the last k blocks of n // (k + 1) rows are the tests; ``fold`` is 0 before the first test.

    Fold i is tested on rows with ``fold = i`` and trained on rows with ``fold < i``.
    """
    size = F.floor(F.col("n") / (k + 1))
    cuts = row_cuts(df, {f"f{i}": F.col("n") - (k - i) * size for i in range(k)}, time, key)
    bounds = cuts.agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(key).alias("k"))))).scalar()
    here = F.struct(F.col(time).alias("t"), F.col(key).alias("k"))
    passed = [F.when(here > F.element_at(bounds, i + 1), 1).otherwise(0) for i in range(k)]
    return df.withColumn("fold", sum(passed[1:], passed[0]))
