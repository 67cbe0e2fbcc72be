"""Live stations, rebalancing actions and the action board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.functions.cleaning import truncate
from dockflow.operators.joins import live_stations
from dockflow.operators.ranking import PRIORITY_ORDER, mapped_rank

DEFAULT_CAPACITY = 30


def station_state(info: DataFrame, status: DataFrame, status_order: list[str]) -> DataFrame:
    """Stations with their latest status: missing values replaced, codes as booleans, fill rates.

    ``fill_rate_sum`` adds electric bikes to a total that already counts them, as dashboards of this feed do;
    ``fill_rate`` is bikes over capacity. Both are 0 without capacity.
    """
    s = live_stations(info, status, status_order)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    bikes, ebikes, docks, cap = zero("bikes"), zero("ebikes"), zero("docks"), zero("capacity")
    rate = lambda n: F.when(cap > 0, n / F.nullif(cap, F.lit(0))).otherwise(0.0)
    return s.select("station_id", F.coalesce("name", F.lit("Unknown Station")).alias("name"), cap.alias("capacity"), bikes.alias("bikes"),
                    ebikes.alias("ebikes"), docks.alias("docks"), (F.coalesce("is_renting", F.lit(0)) == 1).alias("is_renting"),
                    "last_reported", rate(bikes + ebikes).alias("fill_rate_sum"), rate(bikes).alias("fill_rate"))


def rebalancing_actions(stations: DataFrame, rounding: str = "trunc", per_trip: int | None = 15, mark: str | None = None) -> DataFrame:
    """Action, quantity and priority of every station that needs one; ``rounding`` is ``trunc`` or ``ceil``.

    A trip moves ``per_trip`` bikes at most; None for no limit. ``mark`` names a column that tells quantities that were cut.
    """
    whole = truncate if rounding == "trunc" else F.ceil
    cap = F.when(F.col("capacity") > 0, F.col("capacity")).when(F.col("bikes") + F.col("docks") > 0, F.col("bikes") + F.col("docks")).otherwise(DEFAULT_CAPACITY)
    base = stations.withColumn("capacity", cap).withColumn("fill", F.col("bikes") / F.col("capacity"))
    fill, bikes, capacity = F.col("fill"), F.col("bikes"), F.col("capacity")
    action = F.when(fill < 0.15, "RESTOCK").when(fill > 0.85, "PICKUP").when(fill < 0.25, "RESTOCK").when(fill > 0.75, "PICKUP").otherwise("HOLD")
    quantity = (F.when(fill < 0.15, whole(capacity * 0.4 - bikes)).when(fill > 0.85, whole(bikes - capacity * 0.6))
                .when(fill < 0.25, whole(capacity * 0.35 - bikes)).when(fill > 0.75, whole(bikes - capacity * 0.65)).otherwise(0))
    priority = (F.when((fill < 0.05) | (fill > 0.95), "CRITICAL").when((fill < 0.15) | (fill > 0.85), "HIGH")
                .when((fill < 0.25) | (fill > 0.75), "MEDIUM").otherwise("LOW"))
    found = (base.select("station_id", "name", action.alias("action"), quantity.cast("long").alias("quantity"), priority.alias("priority"),
                        bikes.alias("current_bikes"), F.col("docks").alias("current_docks"), capacity.alias("capacity"),
                        F.rint(fill * 100).cast("long").alias("fill_pct"))
             .where("action <> 'HOLD' and quantity > 0"))
    if mark is not None:
        found = found.withColumn(mark, F.lit(False) if per_trip is None else F.col("quantity") > per_trip)
    return found if per_trip is None else found.withColumn("quantity", F.least("quantity", F.lit(per_trip)))


def action_board(actions: DataFrame, n: int = 50) -> DataFrame:
    """The n most urgent actions, by priority and station."""
    return actions.orderBy(mapped_rank(F.col("priority"), PRIORITY_ORDER), "station_id").limit(n)


def fleet_kpis(actions: DataFrame) -> DataFrame:
    """Pending actions, critical ones, bikes to move and a health figure of 0..100."""
    critical, high = F.count_if(F.col("priority") == "CRITICAL"), F.count_if(F.col("priority") == "HIGH")
    health = F.when(F.count(F.lit(1)) == 0, 100).otherwise(F.greatest(F.lit(0), 100 - 5 * critical - 2 * high))
    return actions.agg(F.count_if(F.col("action") != "HOLD").alias("pending"), critical.alias("critical"),
                       F.coalesce(F.sum("quantity"), F.lit(0)).alias("bikes_to_move"), health.cast("long").alias("health"))


def dispatch(actions: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Actions whose station was not dispatched yet."""
    return actions.join(dispatched.select("station_id"), "station_id", "left_anti")
