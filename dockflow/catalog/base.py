"""Registry of named queries with their check SQL, and the views both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Data:
    """The given tables in the shapes the operators expect."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def trips(self) -> DataFrame:
        """Events as trips: the value is the length in minutes, the number in ``props`` the end station."""
        return trips_from_events(self.table("events"))

    def stations(self) -> DataFrame:
        uid = F.col("user_id")
        return self.table("events").select(uid).distinct().select(
            station_name(uid).alias("station_name"), *position(uid))

    def weather(self) -> DataFrame:
        """Hourly weather with gaps, from the values of three event types."""
        kind, v = F.col("event_type"), F.col("value")
        return (self.table("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"))
                .agg((F.avg(F.when(kind == "view", v)) / 4.9).alias("temp"),
                     (F.sum(F.when(kind == "error", v).otherwise(0.0)) / 97.0).alias("prcp"),
                     (F.avg(F.when(kind == "click", v)) / 9.7).alias("wspd")))

    def points(self) -> DataFrame:
        """One weighted point per event, scattered over the area of the stations."""
        i = F.col("event_id")
        return self.table("events").select(
            i.alias("point_id"), (F.lit(40.70) + (i % 997) * F.lit(1e-3)).alias("lat"), (F.lit(-74.02) + (i % 1009) * F.lit(5e-4)).alias("lon"),
            F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("weight"))

    def station_info(self) -> DataFrame:
        return self.table("part").select(F.col("p_partkey").alias("station_id"), F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("capacity"))

    def station_status(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("station_id"), F.col("l_shipdate").alias("last_reported"), F.floor("l_quantity").cast("long").alias("bikes"),
            F.col("l_linenumber").cast("long").alias("ebikes"), F.floor(F.col("l_tax") * 100).cast("long").alias("docks"),
            F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("is_renting"), F.col("l_orderkey").alias("ord"))

    def order_days(self) -> DataFrame:
        """Orders as hourly sums of a long period (all at midnight) for the daily operators."""
        return self.table("orders").groupBy(F.col("o_orderdate").alias("hour")).agg(F.count(F.lit(1)).alias("trip_count"))

    def day_weather(self) -> DataFrame:
        """Daily weather of the order days, from prices."""
        return (self.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("date"))
                .agg((F.avg("o_totalprice") / 9973.0).alias("temp"), (F.min("o_totalprice") / 9973.0).alias("prcp")))


STATUS_ORDER = ["last_reported", "ord", "ebikes", "bikes", "docks"]


def station_name(number):
    return F.concat(F.lit("station "), number.cast("string"))


def position(number):
    return (F.lit(40.70) + (number % 15) * F.lit(5e-3)).alias("lat"), (F.lit(-74.02) + F.floor(number / 15) * F.lit(5e-3)).alias("lon")


def trips_from_events(events: DataFrame) -> DataFrame:
    length = F.floor(F.col("value") * 60_000_000.0).cast("long")
    end = F.regexp_extract("props", "[0-9]+", 0)
    return events.select(
        F.col("event_id").alias("trip_id"), F.col("ts").alias("started_at"),
        F.timestamp_add("MICROSECOND", length, F.col("ts")).alias("ended_at"),
        station_name(F.col("user_id")).alias("start_station_name"), F.concat(F.lit("station "), end).alias("end_station_name"),
        F.when(F.col("event_type").isin("purchase", "signup"), "member").otherwise("casual").alias("member_casual"),
        F.col("event_type").alias("rideable_type"))


# Views of the check SQL: name -> (views it needs, select)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "trips": ((), """
        select event_id trip_id, ts started_at, ts + to_microseconds(cast(floor(value*60000000.0) as bigint)) ended_at,
               'station ' || user_id start_station_name, 'station ' || regexp_extract(props, '[0-9]+') end_station_name,
               case when event_type in ('purchase','signup') then 'member' else 'casual' end member_casual, event_type rideable_type
        from events"""),
    "stations": ((), """
        select distinct 'station ' || user_id station_name, 40.70 + (user_id%15)*5E-3 lat, -74.02 + floor(user_id/15)*5E-3 lon from events"""),
    "weather": ((), """
        select date_trunc('hour',ts) time, avg(case when event_type='view' then value end)/4.9E0 temp,
               sum(case when event_type='error' then value else 0E0 end)/97E0 prcp, avg(case when event_type='click' then value end)/9.7E0 wspd
        from events group by 1"""),
    "points": ((), """
        select event_id point_id, 40.70E0 + (event_id%997)*1E-3 lat, -74.02E0 + (event_id%1009)*5E-4 lon, event_type kind,
               cast(floor(value) as bigint) weight from events"""),
    "station_info": ((), "select p_partkey station_id, p_name name, cast(p_size as bigint) capacity from part"),
    "station_status": ((), """
        select l_partkey station_id, l_shipdate last_reported, cast(floor(l_quantity) as bigint) bikes, cast(l_linenumber as bigint) ebikes,
               cast(floor(l_tax*100) as bigint) docks, case when l_linestatus='O' then 1 else 0 end is_renting, l_orderkey ord from lineitem"""),
    "pickups": (("trips",), "select start_station_name station_name, date_trunc('hour', started_at) time, count(*) pickups from trips group by 1,2"),
    "dropoffs": (("trips",), "select end_station_name station_name, date_trunc('hour', ended_at) time, count(*) dropoffs from trips group by 1,2"),
    "hourly": (("pickups", "dropoffs"), """
        select station_name, time, coalesce(pickups,0) pickups, coalesce(dropoffs,0) dropoffs, coalesce(dropoffs,0)-coalesce(pickups,0) net_demand
        from pickups full outer join dropoffs using (station_name, time)"""),
    "quality": (("hourly",), """
        select *, volume*coverage/(least(greatest(cv,0.5),3.0)+1) score from (
          select *, least(1.0, greatest(0.0, data_points/(days_active*24+1))) coverage, std/(mean+1E-6) cv from (
            select station_name, count(pickups) data_points, sum(pickups) volume, avg(pickups) mean, stddev_samp(pickups) std, min(time) first_time,
                   max(time) last_time, date_diff('second', min(time), max(time))/86400E0 days_active from hourly group by 1))"""),
    "kept": (("hourly",), "select * from hourly"),
    "spine": (("kept",), "select unnest(range(min(time), max(time) + interval 1 hour, interval 1 hour)) time from kept"),
    "grid": (("kept", "spine"), """
        select s.station_name, t.time, coalesce(k.pickups,0) pickups, coalesce(k.dropoffs,0) dropoffs, coalesce(k.net_demand,0) net_demand
        from (select distinct station_name from kept) s cross join spine t left join kept k on k.station_name=s.station_name and k.time=t.time"""),
    "order_days": ((), "select o_orderdate as hour, count(*) trip_count from orders group by 1"),
    "day_weather": ((), """
        select cast(o_orderdate as date) date, avg(o_totalprice)/9973E0 temp, min(o_totalprice)/9973E0 prcp from orders group by 1"""),
    "daily": (("order_days",), """
        select cast(d as date) date, coalesce(n,0) trip_count from
          (select unnest(range(min(cast(hour as date)), max(cast(hour as date)) + interval 1 day, interval 1 day)) d from order_days)
          left join (select cast(hour as date) dd, sum(trip_count) n from order_days group by 1) on dd = cast(d as date)"""),
    "years": ((), "select unnest(range(1990, 2031)) y"),
    "holidays": (("years",), """
        select distinct h date from (
          select unnest([make_date(y,1,1), make_date(y,7,4), make_date(y,11,11), make_date(y,12,25),
                         case when y >= 2021 then make_date(y,6,19) end]) h from years
          union all
          select case when isodow(d)=6 then cast(d - interval 1 day as date) when isodow(d)=7 then cast(d + interval 1 day as date) end from (
            select unnest([make_date(y,1,1), make_date(y,7,4), make_date(y,11,11), make_date(y,12,25),
                           case when y >= 2021 then make_date(y,6,19) end]) d from years)
          union all
          select cast(d as date) from (select unnest(range(make_date(1990,1,1), make_date(2031,1,1), interval 1 day)) d)
          where (isodow(d)=1 and ((month(d)=1 and day(d) between 15 and 21) or (month(d)=2 and day(d) between 15 and 21) or (month(d)=5 and day(d) >= 25)
                 or (month(d)=9 and day(d) <= 7) or (month(d)=10 and day(d) between 8 and 14))) or (isodow(d)=4 and month(d)=11 and day(d) between 22 and 28)
        ) where h is not null"""),
    "weather_filled": (("weather",), """
        select time,
          coalesce(last_value(temp ignore nulls) over (order by time rows unbounded preceding), first_value(temp ignore nulls) over (order by time rows between current row and unbounded following)) temp,
          coalesce(last_value(prcp ignore nulls) over (order by time rows unbounded preceding), first_value(prcp ignore nulls) over (order by time rows between current row and unbounded following)) prcp,
          coalesce(last_value(wspd ignore nulls) over (order by time rows unbounded preceding), first_value(wspd ignore nulls) over (order by time rows between current row and unbounded following)) wspd
        from weather"""),
    "hour_weather": (("spine", "weather_filled"), """
        with j as (select s.time, temp, prcp, wspd from spine s left join weather_filled w on w.time = s.time)
        select time, coalesce(temp, (select quantile_cont(temp,0.5) from j)) temp, coalesce(prcp, (select quantile_cont(prcp,0.5) from j)) prcp,
               coalesce(wspd, (select quantile_cont(wspd,0.5) from j)) wspd from j"""),
    "backcast": (("hourly",), """
        select h.station_name, h.time, h.pickups actual, greatest(0, 0.6*hm + 0.3*dm + 0.1*om) predicted from hourly h
          join (select station_name, hour(time) hh, avg(pickups) hm from hourly group by 1,2) a on a.station_name=h.station_name and a.hh=hour(h.time)
          join (select station_name, isodow(time) dd, avg(pickups) dm from hourly group by 1,2) b on b.station_name=h.station_name and b.dd=isodow(h.time)
          join (select station_name, avg(pickups) om from hourly group by 1) c on c.station_name=h.station_name"""),
}


def check(body: str, *views: str) -> str:
    """A check query with the views it needs as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for v in views:
        need(v)
    if not order:
        return body.strip()
    body = body.strip()
    body = "," + body[4:] if body.startswith("with") else "\n" + body
    return "with " + ",\n".join(f"{v} as ({VIEWS[v][1].strip()})" for v in order) + body


def query(name: str, sql: str | None = None, *views: str):
    """Register a function of (Data) under a name, with its check SQL if it can be stated."""
    def add(fn: Callable[[Data], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            from dockflow.session import prepare
            return fn(Data(prepare(spark), folder))
        run.__name__ = run.__qualname__ = name
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = check(sql, *views)
        return fn
    return add


def rounded(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    """Doubles rounded for comparison (all of them unless named)."""
    pick = set(cols) or {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.round(c, digits).alias(c) if c in pick else F.col(c) for c in df.columns])
