"""Time series operators per station: complete grid, lags, rolling statistics, exponential average, fills and history.

All of them work on series that hold one row per station and hour (or day). The rows of one station are therefore
bounded by the hours of the covered period, however many trips the station has; windows are partitioned by station.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.operators.quantiles import attach

HOUR = "INTERVAL '1' HOUR"
TASK_ROWS = 1 << 17  # rows of the complete grid that a task of the windows holds


def _by(part: str | None, *order):
    return Window.partitionBy(part).orderBy(*order) if part else Window.orderBy(*order)


def densify(series: DataFrame, values: list[str], key: str = "station_name", time: str = "time") -> DataFrame:
    """Complete hourly grid between the first and the last hour of the whole series, missing values 0.

    Every row is stretched up to the next row of its station, and the first row also back to the common start. The only
    shuffle is the one by station that the following lag and rolling windows use too; no stations x hours product is
    built or joined. Its number of tasks goes by the rows of the grid, of which the shuffled rows tell little: a task holds about
    TASK_ROWS of them, or one station if that has more. Few rows are left to adaptive execution. The series is read once
    to count them, so it should be staged.
    """
    ends = series.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    tasks = grid_tasks(series, key, time)
    if tasks > series.sparkSession.sparkContext.defaultParallelism:
        series = series.repartition(tasks, key)
    w = _by(key, time)
    step = F.expr(HOUR)
    stop = F.coalesce(F.lead(time).over(w) - step, F.col("_s.hi"))
    begin = F.when(F.lag(time).over(w).isNull(), F.col("_s.lo")).otherwise(F.col(time))
    spread = (attach(series.select(key, time, *values), ends)
              .withColumn("begin", begin).withColumn("stop", stop)
              .withColumn("slot", F.explode(F.sequence("begin", "stop", step))))
    here = F.col("slot") == F.col(time)
    return spread.select(key, F.col("slot").alias(time), *[F.when(here, F.col(v)).otherwise(F.lit(0)).alias(v) for v in values])


def grid_tasks(series: DataFrame, key: str = "station_name", time: str = "time") -> int:
    """So many tasks hold the complete grid of a series with about TASK_ROWS rows each; no more than there are stations."""
    hours = F.timestamp_diff("HOUR", F.min(time), F.max(time)) + 1
    size = series.agg(F.approx_count_distinct(key).alias("stations"), hours.alias("hours")).first()
    return min(size["stations"], math.ceil(size["stations"] * (size["hours"] or 0) / TASK_ROWS))


def daily_series(hourly: DataFrame, time: str = "hour", value: str = "trip_count") -> DataFrame:
    """Sum per day with every day between the first and the last present (gaps are 0).

    Runs over the daily sums of the whole system, one row per calendar day, hence the window without partition.
    """
    daily = hourly.groupBy(F.col(time).cast("date").alias("date")).agg(F.sum(value).alias(value))
    w = Window.orderBy("date")
    stop = F.coalesce(F.date_sub(F.lead("date").over(w), 1), F.col("date"))
    return (daily.withColumn("stop", stop).withColumn("slot", F.explode(F.sequence("date", "stop")))
            .select(F.col("slot").alias("date"), F.when(F.col("slot") == F.col("date"), F.col(value)).otherwise(F.lit(0)).alias(value)))


def add_lags(df: DataFrame, col: str, lags: list[int], key: str | None = "station_name", time: str = "time", fill: float | None = None) -> DataFrame:
    """Values k rows back; on the complete grid these are hours, on a sparse series previous rows."""
    w = _by(key, time)
    def lagged(k):
        c = F.lag(col, k).over(w)
        return c if fill is None else F.coalesce(c, F.lit(fill))
    return df.select("*", *[lagged(k).alias(f"lag_{k}h") for k in lags])


def _sliding_extremes(col: str, windows: list[int], w) -> list[list[Column]]:
    """Minimum and maximum over the previous rows, in steps: each window is built from the next smaller one.

    An extreme may use a value twice, so a window of n rows is the extreme of a few shifted smaller windows; the cost
    per row is the number of shifts instead of n. Rows before the start are null and are skipped by least/greatest.
    """
    steps, smaller = [], None
    for n in sorted(windows):
        columns = []
        for name, pick in (("min", F.least), ("max", F.greatest)):
            if smaller is None:
                parts = [F.lag(col, k).over(w) for k in range(1, n + 1)]
            else:
                source = f"roll_{name}_{smaller}h"
                starts = [*range(0, n - smaller, smaller), n - smaller]
                parts = [F.col(source) if s == 0 else F.lag(source, s).over(w) for s in starts]
            columns.append((pick(*parts) if len(parts) > 1 else parts[0]).alias(f"roll_{name}_{n}h"))
        steps.append(columns)
        smaller = n
    return steps


def add_rolling(df: DataFrame, col: str, windows: list[int], key: str | None = "station_name", time: str = "time",
                std_fill: float | None = 1.0, whole_numbers: bool = True, zero_fill: bool = False) -> DataFrame:
    """Mean, standard deviation (n - 1), minimum and maximum of the previous rows, the current row excluded.

    For counts the mean and the deviation come from running sums and their lag, which stay exact in whole numbers and
    cost the same for every window length. Other columns use plain frames. ``std_fill`` replaces an undefined deviation.
    All steps keep the partitioning and order of the first one: one shuffle, one sort.
    """
    w = _by(key, time)
    keep = df.columns
    steps = _sliding_extremes(col, windows, w)
    if whole_numbers:
        x, upto = F.col(col).cast("long"), w.rowsBetween(Window.unboundedPreceding, -1)
        out = df.select("*", *steps[0], F.sum(x).over(upto).alias("_s1"), F.sum(x * x).over(upto).alias("_s2"), F.count(col).over(upto).alias("_n"))
        stats = []
        for n in windows:
            s1, s2, m = (F.col(c) - F.coalesce(F.lag(c, n).over(w), F.lit(0)) for c in ("_s1", "_s2", "_n"))
            stats += [s1.alias(f"_s1_{n}"), s2.alias(f"_s2_{n}"), m.alias(f"_n_{n}")]
    else:
        out, stats = df.select("*", *steps[0]), []
        for n in windows:
            frame = w.rowsBetween(-n, -1)
            stats += [F.avg(col).over(frame).alias(f"roll_mean_{n}h"), F.stddev_samp(col).over(frame).alias(f"roll_std_{n}h")]
    later = steps[1:] or [[]]
    for i, step in enumerate(later):
        out = out.select("*", *step, *(stats if i == 0 else []))
    final = []
    for n in windows:
        s1, s2, m = F.col(f"_s1_{n}"), F.col(f"_s2_{n}"), F.col(f"_n_{n}")
        exact = {"mean": s1 / F.nullif(m, F.lit(0)), "std": F.sqrt((m * s2 - s1 * s1) / F.nullif(m * (m - 1), F.lit(0)))} if whole_numbers else {}
        for stat in ("mean", "std", "min", "max"):
            c = exact.get(stat, F.col(f"roll_{stat}_{n}h"))
            if stat == "std" and std_fill is not None:
                c = F.coalesce(c, F.lit(std_fill))
            elif zero_fill:
                c = F.coalesce(c, F.lit(0))
            final.append(c.alias(f"roll_{stat}_{n}h"))
    return out.select(*keep, *final)


def ema(df: DataFrame, col: str, span: int, out: str, key: str = "station_name", time: str = "time", fill: float | None = None) -> DataFrame:
    """Exponential average of the previous values: y0 = x0, then y = a x + (1 - a) y with a = 2 / (span + 1).

    The recurrence is cut into blocks. Inside a block it is a running sum of scaled values; the block length is chosen so
    that the scale stays below 1e9. The state carried over block borders needs two earlier blocks: the weight of a third is
    below 1e-18, less than the precision of a double. All windows are partitioned by station, so one shuffle serves them.
    """
    a = 2.0 / (span + 1)
    q = 1.0 - a
    block = max(1, int(math.log(1e9) / -math.log(q))) if q > 0 else 1
    keep = df.columns
    w = _by(key, time)
    rows = (df.withColumn("_x", F.lag(col, 1).over(w).cast("double"))
            .withColumn("_i", F.row_number().over(w) - 2)
            .withColumn("_b", F.floor(F.col("_i") / block)).withColumn("_k", F.pmod(F.col("_i"), F.lit(block))))
    scaled = F.when(F.col("_i") < 0, None).when(F.col("_i") == 0, F.col("_x")).otherwise(F.lit(a) * F.col("_x")) * F.pow(F.lit(q), -F.col("_k"))
    inside = Window.partitionBy(key, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_loc", F.sum(scaled).over(inside) * F.pow(F.lit(q), F.col("_k")))
    before = Window.partitionBy(key).orderBy("_b", "_k").rowsBetween(Window.unboundedPreceding, -1)
    at_end = (F.col("_k") == block - 1) & (F.col("_i") >= 0)
    carry = F.lit(0.0)
    for step in range(2):
        rows = rows.withColumn(f"_c{step}", F.last(F.when(at_end, F.col("_loc") + F.lit(q ** block) * carry), True).over(before))
        carry = F.coalesce(F.col(f"_c{step}"), F.lit(0.0))
    value = F.when(F.col("_i") >= 0, F.col("_loc") + carry * F.pow(F.lit(q), F.col("_k") + 1))
    if fill is not None:
        value = F.coalesce(value, F.lit(fill))
    return rows.select(*keep, value.alias(out))


def add_changes(df: DataFrame, col: str = "pickups") -> DataFrame:
    """Change against one and 24 rows back (for reports; as a feature it would leak the target)."""
    return df.select("*", (F.col(col) - F.col("lag_1h")).alias("demand_change_1h"), (F.col(col) - F.col("lag_24h")).alias("demand_change_24h"))


def trend_band(daily: DataFrame, n: int = 7, value: str = "trip_count", z: float = 1.96) -> DataFrame:
    """Trailing mean over n days and its band; 0 until n days exist. One row per calendar day."""
    w = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    full = F.count(value).over(w) == n
    ma = F.when(full, F.avg(value).over(w)).otherwise(0.0)
    std = F.when(full, F.stddev_samp(value).over(w)).otherwise(0.0)
    return daily.select("date", ma.alias("ma"), (ma + z * std).alias("upper_ci"), (ma - z * std).alias("lower_ci"))


def smooth(daily: DataFrame, k: int, value: str = "trip_count") -> DataFrame:
    """Centred moving average over k rows on both sides, shorter at the ends, rounded half up. One row per day."""
    if k <= 0:
        return daily.withColumn(f"{value}_smooth", F.col(value).cast("long"))
    w = Window.orderBy("date").rowsBetween(-k, k)
    return daily.withColumn(f"{value}_smooth", F.floor(F.avg(value).over(w) + 0.5))


def ffill_bfill(df: DataFrame, cols: list[str], order: str, part: str | None = None) -> DataFrame:
    """Fill gaps with the last known value, then leading gaps with the next known one.

    Only leading rows are still empty after the first fill, and for those the next known value is the first of all, so both
    frames are computed once per group.
    """
    w = _by(part, order)
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = {c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(whole)) for c in cols}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])


def history_before(series: DataFrame, requests: DataFrame, n: int = 168, key: str = "station_name", time: str = "time") -> DataFrame:
    """The last n rows strictly before each requested (station, at_time); ``back`` is 1 for the newest.

    Rows get their number within the station; a request finds the number of its last earlier row in the same ordered
    pass and asks for a fixed range of numbers, so requests meet rows by equality only.
    """
    rows = series.select(key, time, *[c for c in series.columns if c not in (key, time)])
    marks = (rows.select(key, F.col(time).alias("_t"), F.lit(1).alias("_row"))
             .unionByName(requests.select(key, F.col("at_time").alias("_t"), F.lit(0).alias("_row")).distinct()))
    w = Window.partitionBy(key).orderBy("_t", "_row").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("_upto", F.sum("_row").over(w))
    asked = (marks.where("_row = 0 and _upto > 0")
             .select(key, F.col("_t").alias("at_time"), "_upto", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_upto") - (n - 1)), F.col("_upto"))).alias("_no"))
             .withColumn("back", (F.col("_upto") - F.col("_no") + 1).cast("int")).drop("_upto"))
    numbered = rows.withColumn("_no", F.row_number().over(_by(key, time)).cast("long"))
    return asked.join(numbered, [key, "_no"]).drop("_no")


def sequences(df: DataFrame, col: str, n: int = 24, key: str = "station_name", time: str = "time") -> DataFrame:
    """The n previous values as an array for every row that has them."""
    w = _by(key, time).rowsBetween(-n, -1)
    return df.select(key, time, col, F.collect_list(col).over(w).alias("seq")).where(F.size("seq") == n)


def serving_features(history: DataFrame, keys: list[str], value: str = "pickups", span: int = 24, sample: bool = False) -> DataFrame:
    """Features at forecast time from the last rows of each request (``back`` = 1 is the newest).

    Lags that reach before the history are 0; statistics need a full window, else 0; deviation with n, or with n - 1 if ``sample``. The exponential
    average is the closed form of its recurrence over the history and needs 24 rows. Everything is one aggregate.
    """
    a = 2.0 / (span + 1)
    q = 1.0 - a
    back, x = F.col("back"), F.col(value).cast("double")
    total = F.count(F.lit(1))
    aggs = [total.alias("n_hist")]
    for k in (1, 2, 3, 6, 12, 24, 48, 168):
        aggs.append(F.coalesce(F.max(F.when(back == k, x)), F.lit(0.0)).alias(f"lag_{k}h"))
    for n in (4, 12, 24, 168):
        inside = F.when(back <= n, x)
        for stat, fn in (("mean", F.avg), ("std", F.stddev_samp if sample else F.stddev_pop), ("min", F.min), ("max", F.max)):
            aggs.append(F.when(total >= n, fn(inside)).otherwise(0.0).alias(f"roll_{stat}_{n}h"))
    weighted = F.sum(F.lit(a) * F.pow(F.lit(q), back - 1) * x)
    oldest = F.max_by(F.lit(q) * F.pow(F.lit(q), back - 1) * x, back)
    aggs.append(F.when(total >= 24, weighted + oldest).otherwise(0.0).alias(f"ema_{span}h"))
    return history.groupBy(*keys).agg(*aggs)


def latest_weather(history: DataFrame, keys: list[str], defaults: dict[str, float]) -> DataFrame:
    """Weather of the newest history row, the default where it is null."""
    return history.groupBy(*keys).agg(*[F.coalesce(F.min_by(c, "back"), F.lit(v)).alias(c) for c, v in defaults.items()])
