"""Streaming queries: each runs over the landed files until they are used up and returns what was written."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.catalog.base import Data, STATUS_ORDER, VIEWS, query, rounded, trips_from_events
from dockflow.catalog.dashboard import board_sql
from dockflow.operators.quantiles import attach
from dockflow.operators.ranking import latest
from dockflow.session import stage, stage_path
from dockflow.streaming import live


BATCHES, FILES = 4, 2  # micro-batches that the given tables are landed in, and files of each

# Trips land in four batches by time; one in ten comes one batch late and one in ten two. Late rows of a batch are told by the mark that held
# for the batch before it: the newest start till then less the allowed delay. What ends at or before the mark is dropped.
VIEWS["landed"] = (("trips",), """
    select *, least(3, slice + case trip_id % 10 when 0 then 1 when 5 then 2 else 0 end) arrival from
      (select t.*, (4 * (epoch_us(started_at) - lo)) // (hi - lo + 1) slice from trips t, (select epoch_us(min(started_at)) lo, epoch_us(max(started_at)) hi from trips))""")
VIEWS["marks"] = (("landed",), """
    select b.arrival, date_trunc('milliseconds', max(started_at)) - interval 1 hour mark from (select distinct arrival from landed) b left join landed on landed.arrival < b.arrival - 1 group by 1""")
VIEWS["kept_trips"] = (("landed", "marks"), "select landed.* from landed join marks on marks.arrival = landed.arrival where mark is null or started_at > mark")


def arrival(events: DataFrame) -> DataFrame:
    """The given events with the batch that each lands in."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ends = events.agg(F.min(micros).alias("lo"), F.max(micros).alias("hi"))
    late = F.when(F.col("event_id") % 10 == 0, 1).when(F.col("event_id") % 10 == 5, 2).otherwise(0)
    slice_ = F.floor(F.lit(BATCHES) * (micros - F.col("_s.lo")) / (F.col("_s.hi") - F.col("_s.lo") + 1))
    return attach(events, ends).withColumn("arrival", F.least(F.lit(BATCHES - 1), slice_ + late)).drop("_s")


def trip_stream(d: Data, again: bool = False):
    """The events as a stream of trips, landed in batches; ``again``: each with a copy one batch later."""
    events = stage(arrival(d.table("events")), "arrivals")
    if again:
        events = events.withColumn("arrival", F.explode(F.array("arrival", F.least(F.lit(BATCHES - 1), F.col("arrival") + 1))))
    path = live.land(events, F.col("arrival"), BATCHES, stage_path(d.spark, "landed"), FILES)
    return trips_from_events(live.read_stream(d.spark, path, events.schema, FILES).drop("arrival"))


def naive(df, *cols):
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if c in cols else F.col(c) for c in df.columns])


@query("streamed_hourly_pickups", """
    select start_station_name station_name, date_trunc('hour', started_at) time, count(*) pickups from landed join marks on marks.arrival = landed.arrival
    where (mark is null or date_trunc('hour', started_at) + interval 1 hour > mark) and date_trunc('hour', started_at) + interval 1 hour <= (select date_trunc('milliseconds', max(started_at)) - interval 1 hour from trips)
    group by 1, 2""", "marks")
def _(d: Data):
    path = live.run_to_table(live.hourly_pickups(trip_stream(d)), "streamed-pickups")
    return naive(d.spark.read.parquet(path), "time")


@query("streamed_sliding_demand", """
    with w as (select arrival, unnest(range(date_trunc('hour', started_at) - interval 23 hour, date_trunc('hour', started_at) + interval 1 hour, interval 1 hour)) start from landed)
    select start, start + interval 24 hour as "end", count(*) pickups from w join marks on marks.arrival = w.arrival
    where (mark is null or start + interval 24 hour > mark) and start + interval 24 hour <= (select date_trunc('milliseconds', max(started_at)) - interval 1 hour from trips) group by 1""", "marks")
def _(d: Data):
    path = live.run_to_table(live.sliding_demand(trip_stream(d)), "streamed-sliding")
    return naive(d.spark.read.parquet(path), "start", "end")


@query("streamed_distinct_trips", "select trip_id, start_station_name from kept_trips", "kept_trips")
def _(d: Data):
    """Each trip lands twice and is kept once, unless it comes later than the delay allows."""
    path = live.run_to_table(live.distinct_trips(trip_stream(d, again=True)).select("trip_id", "start_station_name"), "streamed-distinct")
    return d.spark.read.parquet(path)


@query("streamed_enriched_trips", """
    select trip_id, w.time, lat, lon, round(temp,6) temp from trips join stations s on s.station_name = start_station_name left join weather w on w.time = date_trunc('hour', started_at)""", "trips", "stations", "weather")
def _(d: Data):
    out = live.enriched(trip_stream(d), d.stations(), d.weather()).select("trip_id", "time", "lat", "lon", "temp")
    return rounded(d.spark.read.parquet(live.run_to_table(out, "streamed-enriched")), 6, "temp")


def status_stream(d: Data, batches: int = BATCHES):
    """The status rows as a stream: landed in batches that cut across the times of the reports, so later batches hold older reports too."""
    line = d.table("lineitem")
    path = live.land(line, F.col("l_orderkey") % batches, batches, stage_path(d.spark, "landed-status"), FILES)
    return live.read_stream(d.spark, path, line.schema, FILES)


def statuses(d: Data):
    return status_rows(status_stream(d))


def status_rows(line: DataFrame):
    return line.select(F.col("l_partkey").alias("station_id"), F.col("l_shipdate").alias("last_reported"), F.floor("l_quantity").cast("long").alias("bikes"),
                       F.col("l_linenumber").cast("long").alias("ebikes"), F.floor(F.col("l_tax") * 100).cast("long").alias("docks"),
                       F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("is_renting"), F.col("l_orderkey").alias("ord"))


@query("streamed_latest_status", "select * from latest_status", "latest_status")
def _(d: Data):
    state = live.LatestStatus(d.spark, d.station_info(), STATUS_ORDER)
    state.run(statuses(d))
    return state.table(d.spark)


@query("streamed_action_board", board_sql("trunc").replace("from live)", "from (select i.station_id, i.name, i.capacity, l.bikes, l.ebikes, l.docks from station_info i join latest_status l on l.station_id = i.station_id))")
       + "select * from a order by case priority when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end, station_id limit 50", "latest_status", "station_info")
def _(d: Data):
    state = live.LatestStatus(d.spark, d.station_info(), STATUS_ORDER)
    state.run(statuses(d))
    return state.board(d.spark)


@query("served_feed", """
    select station_id, last_reported, ord, ebikes, bikes, docks, is_renting, 2::bigint as version from
      (select *, row_number() over (partition by station_id order by last_reported desc, ord desc, ebikes desc, bikes desc, docks desc) rn from station_status where ord % 4 = 2) where rn = 1""", "station_status")
def _(d: Data):
    """Four snapshots of the feed land as lines of JSON, the second and the last with broken lines: the third is served."""
    rows = latest(d.station_status().withColumn("part", F.col("ord") % 4), ["station_id", "part"], STATUS_ORDER)
    cols = ["station_id", *STATUS_ORDER, "is_renting"]
    text = F.to_json(F.struct(*cols))
    cut = F.when(F.col("part").isin(1, 3) & (F.col("station_id") % 3 == 0), F.substring(text, 1, 20)).otherwise(text)
    root = stage_path(d.spark, "landed-feed")
    lines = stage(rows.select("part", cut.alias("value")), "feed-lines")
    for part in range(4):
        lines.where(F.col("part") == part).select("value").repartition(FILES).write.text(f"{root}/{part:06d}")
    feed = live.FeedTable(d.spark, rows.select(*cols).schema, "station_id")
    feed.run(d.spark, f"{root}/*", FILES)
    return feed.served(d.spark)
