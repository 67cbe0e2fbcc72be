"""Forecast errors: overall, as shown to users, sliced, and model comparisons. Pairs have ``actual`` and ``predicted``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

A, P = "actual", "predicted"


def _r2() -> Column:
    """1 - residual over total sum of squares; the total comes from the population variance, so one pass is enough."""
    residual = F.sum(F.pow(F.col(A) - F.col(P), F.lit(2)))
    total = F.var_pop(A) * F.count(A)
    return F.lit(1.0) - residual / F.nullif(total, F.lit(0.0))


def _mae() -> Column:
    return F.avg(F.abs(F.col(A) - F.col(P)))


def metrics(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """MAE, RMSE, R2 and MAPE (over actuals above 0) in one pass."""
    ape = F.when(F.col(A) > 0, F.abs((F.col(A) - F.col(P)) / F.nullif(F.col(A).cast("double"), F.lit(0.0))))
    aggs = [F.count(F.lit(1)).alias("n"), _mae().alias("mae"), F.sqrt(F.avg(F.pow(F.col(A) - F.col(P), F.lit(2)))).alias("rmse"),
            _r2().alias("r2"), (F.avg(ape) * 100).alias("mape")]
    return pairs.groupBy(*(by or [])).agg(*aggs)


def round_towards(pairs: DataFrame) -> DataFrame:
    """Whole-number forecast, rounded towards the actual; plain rounding where there is none."""
    p, a = F.col(P), F.col(A)
    r = F.when(a.isNull(), F.floor(p + 0.5)).when(p < a, F.ceil(p)).otherwise(F.floor(p))
    return pairs.withColumn(P, r)


def shown_accuracy(pairs: DataFrame) -> DataFrame:
    """Accuracy as shown to users: MAPE leaves out zero actuals in the sum but divides by all pairs."""
    r = round_towards(pairs)
    diff = F.abs(F.col(P) - F.col(A))
    share = F.when(F.col(A) != 0, diff / F.nullif(F.abs(F.col(A)).cast("double"), F.lit(0.0))).otherwise(0.0)
    return r.where(F.col(A).isNotNull()).agg(
        F.avg(diff).alias("mae"), (F.sum(share) / F.count(F.lit(1)) * 100).alias("mape"), F.count(F.lit(1)).alias("samples"),
        F.floor(F.sum(A) + 0.5).cast("long").alias("total_actual"))


def time_period(hour: Column) -> Column:
    return (F.when(hour <= 6, "night").when(hour <= 9, "morning_rush").when(hour <= 16, "midday")
            .when(hour <= 19, "evening_rush").otherwise("evening"))


def sliced_errors(pairs: DataFrame) -> DataFrame:
    """Errors by part of the day and by weekday or weekend from one pass (grouping sets)."""
    base = pairs.select(time_period(F.hour("time")).alias("period"), F.when(F.weekday("time") >= 5, "weekend").otherwise("weekday").alias("day_type"), A, P)
    return (base.groupingSets([[F.col("period")], [F.col("day_type")]], F.col("period"), F.col("day_type"))
            .agg(F.count(F.lit(1)).alias("n"), _mae().alias("mae"), _r2().alias("r2"))
            .select(F.coalesce("period", "day_type").alias("slice"), "n", "mae", "r2"))


def error_distribution(pairs: DataFrame, within: float = 7.0) -> DataFrame:
    """Mean and deviation of the error, share within a band, and the line of prediction on actual."""
    e = F.col(P) - F.col(A)
    return pairs.agg(F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("std_error"),
                     F.avg(F.when(F.abs(e) <= within, 1.0).otherwise(0.0)).alias("share_within"),
                     F.corr(P, A).alias("correlation"), F.regr_slope(P, A).alias("slope"), F.regr_intercept(P, A).alias("intercept"))


def system_profile(pairs: DataFrame) -> DataFrame:
    """System view of actual and predicted demand: mean per hour and sum per day."""
    base = pairs.select("time", F.col("time").cast("date").alias("date"), A, P)
    time, date = F.col("time"), F.col("date")
    return (base.groupingSets([[time], [date]], time, date)
            .agg(F.avg(A).alias("mean_actual"), F.avg(P).alias("mean_predicted"), F.sum(A).alias("sum_actual"), F.sum(P).alias("sum_predicted"))
            .select(time, date, F.when(time.isNotNull(), F.col("mean_actual")).otherwise(F.col("sum_actual")).alias("actual"),
                    F.when(time.isNotNull(), F.col("mean_predicted")).otherwise(F.col("sum_predicted")).alias("predicted")))


def compare_models(pairs: DataFrame, baseline: str) -> DataFrame:
    """Errors per model, best first, with the change of the MAE against a baseline model in percent."""
    m = metrics(pairs, ["model"])
    base = m.where(F.col("model") == baseline).agg(F.max("mae")).scalar()
    return m.withColumn("mae_delta_pct", (F.col("mae") - base) / F.nullif(base, F.lit(0.0)) * 100).orderBy("mae", "model")
