"""Queries on sources, cleaning and rollups."""

from pyspark.sql import functions as F

from dockflow import schemas
from dockflow.catalog.base import Data, query, rounded, station_name
from dockflow.functions import cleaning as c
from dockflow.operators import joins, quantiles, ranking, rollups
from dockflow.plans import dashboards
from dockflow.session import stage, stage_path
from dockflow.sources import files, sinks

TRIP_COLUMNS = ["trip_id", "started_at", "ended_at", "start_station_name", "end_station_name", "member_casual", "rideable_type"]


@query("trip_csv_round_trip", "select member_casual, rideable_type, count(*) n, count(distinct start_station_name) stations, min(started_at) first_start from trips group by 1,2", "trips")
def _(d: Data):
    path = stage_path(d.spark, "trips-csv")
    sinks.write_csv(d.trips(), path, TRIP_COLUMNS)
    schema = schemas.T.StructType([f for n in TRIP_COLUMNS for f in schemas.TRIPS.fields if f.name == n])
    back = files.read_csv(d.spark, [f"{path}-absent", path], schema)
    return back.groupBy("member_casual", "rideable_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("start_station_name").alias("stations"), F.min("started_at").alias("first_start"))


@query("trip_files_union", """
    select trip_id, started_at, ended_at, start_station_name, end_station_name, member_casual, case when trip_id % 3 < 2 then rideable_type end rideable_type from trips""", "trips")
def _(d: Data):
    """Three column orders in one folder, one of them without a column, read back by one glob."""
    path = stage_path(d.spark, "trip-files")
    trips = d.trips()
    for k, names in enumerate((TRIP_COLUMNS, TRIP_COLUMNS[::-1], [n for n in TRIP_COLUMNS if n != "rideable_type"])):
        sinks.write_csv(trips.where(F.col("trip_id") % 3 == k), f"{path}/part={k}", names)
    back = files.read_trip_files(d.spark, [f"{path}/*/*.csv", f"{path}/none/*.csv"], schemas.TRIPS)
    return back.select(*TRIP_COLUMNS)


@query("order_scan", "select * from orders")
def _(d: Data):
    return files.read_parquet(d.spark, f"{d.folder}/orders.parquet")


@query("order_scan_columns", "select o_orderkey, o_orderdate, o_totalprice from orders")
def _(d: Data):
    return files.read_parquet(d.spark, f"{d.folder}/orders.parquet", ["o_orderkey", "o_orderdate", "o_totalprice"])


@query("scan_with_equality", "select event_id, ts, value from events where event_type = 'purchase'")
def _(d: Data):
    return files.read_station(d.spark, f"{d.folder}/events.parquet", "purchase", key="event_type").select("event_id", "ts", "value")


@query("first_existing_table", "select o_orderstatus, count(*) n from orders group by 1")
def _(d: Data):
    path = files.first_existing(d.spark, [f"{d.folder}/no_full_table.parquet", f"{d.folder}/orders.parquet", f"{d.folder}/events.parquet"])
    return d.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("asset_points_by_kind", "select kind, count(*) n, sum(weight)::bigint weight from points group by 1", "points")
def _(d: Data):
    path = stage_path(d.spark, "asset")
    sinks.write_json(d.points(), path)
    points = files.read_json_asset(d.spark, path, d.points().schema, lines=True)
    return dashboards.point_summary(points, 0.01)["types"]


@query("asset_points_by_cell", "select cast(floor(lat/0.01) as bigint) cell_y, cast(floor(lon/0.01) as bigint) cell_x, sum(weight)::bigint weight, count(*) n from points group by 1,2", "points")
def _(d: Data):
    return dashboards.point_summary(d.points(), 0.01)["cells"]


@query("feed_snapshot", """
    select cast(l_partkey as varchar) station_id, count(*) n, sum(cast(floor(l_quantity) as bigint))::bigint bikes, max(epoch(l_shipdate))::bigint last_reported
    from lineitem group by 1""")
def _(d: Data):
    """Nested feed documents (one per order) taken apart into one row per station."""
    line = d.table("lineitem")
    entry = F.struct(F.col("l_partkey").cast("string").alias("station_id"), F.floor("l_quantity").cast("long").alias("num_bikes_available"),
                     F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("last_reported"))
    docs = line.groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(F.collect_list(entry).alias("stations")).alias("data"))).alias("doc"))
    feed = docs.select(files.json_fields(F.col("doc"), schemas.FEED_STATUS).alias("f")).select("f.*")
    return files.explode_feed(feed).groupBy("station_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("num_bikes_available").alias("bikes"), F.max("last_reported").alias("last_reported"))


@query("weather_chunks", "select time, round(temp,6) temp, round(prcp,6) prcp, round(wspd,6) wspd from weather", "weather")
def _(d: Data):
    path = stage_path(d.spark, "weather")
    w = d.weather()
    w.where(F.day("time") <= 15).write.parquet(f"{path}/a")
    w.where(F.day("time") >= 15).write.parquet(f"{path}/b")  # the 15th is delivered twice
    return rounded(files.read_weather(d.spark, [f"{path}/a", f"{path}/b"]))


@query("staged_hourly_totals", "select time, sum(pickups)::bigint pickups, sum(dropoffs)::bigint dropoffs from hourly group by 1", "hourly")
def _(d: Data):
    return stage(rollups.station_hourly(d.trips()), "hourly").groupBy("time").agg(F.sum("pickups").alias("pickups"), F.sum("dropoffs").alias("dropoffs"))


@query("station_clustered_write", "select station_name, count(*) n_hours, sum(pickups)::bigint pickups from hourly group by 1", "hourly")
def _(d: Data):
    path = stage_path(d.spark, "clustered")
    sinks.write_by_station(rollups.station_hourly(d.trips()), path)
    return d.spark.read.parquet(path).groupBy("station_name").agg(F.count(F.lit(1)).alias("n_hours"), F.sum("pickups").alias("pickups"))


@query("station_records", """select to_json({station_name: station_name, pickups: sum(pickups)::bigint, hours: count(*)})::varchar record from hourly group by station_name""", "hourly")
def _(d: Data):
    h = rollups.station_hourly(d.trips()).groupBy("station_name").agg(F.sum("pickups").alias("pickups"), F.count(F.lit(1)).alias("hours"))
    return sinks.records(h)


@query("station_keyed_records", """select '{"' || station_name || '":' || to_json({pickups: sum(pickups)::bigint, hours: count(*)})::varchar || '}' record from hourly group by station_name""", "hourly")
def _(d: Data):
    h = rollups.station_hourly(d.trips()).groupBy("station_name").agg(F.sum("pickups").alias("pickups"), F.count(F.lit(1)).alias("hours"))
    return sinks.keyed_records(h, "station_name")


@query("recovered_stations", """
    select station_name, coalesce(arg_min(lat, (time, lat, lon)), 40.7128) lat, coalesce(arg_min(lon, (time, lat, lon)), -74.0060) lon from (
      select 'station ' || user_id station_name, ts time, case when user_id % 7 <> 3 and value > 10 then 40.70 + (user_id%15)*5E-3 end lat,
             case when user_id % 7 <> 3 and value > 10 then -74.02 + floor(user_id/15)*5E-3 end lon from events) group by 1""")
def _(d: Data):
    known = (F.col("user_id") % 7 != 3) & (F.col("value") > 10)
    facts = d.table("events").select(station_name(F.col("user_id")).alias("station_name"), F.col("ts").alias("time"),
                                     F.when(known, F.lit(40.70) + (F.col("user_id") % 15) * F.lit(5e-3)).alias("lat"),
                                     F.when(known, F.lit(-74.02) + F.floor(F.col("user_id") / 15) * F.lit(5e-3)).alias("lon"))
    return joins.recover_stations(facts)


# ------------------------------------------------------------------------------------------------------ cleaning

@query("clean_trips", """
    select trip_id, started_at, ended_at, start_station_name from trips
    where ended_at - started_at >= interval 1 minute and ended_at - started_at <= interval 24 hours and start_station_name <> ''""", "trips")
def _(d: Data):
    keep = c.valid_station(F.col("start_station_name")) & c.valid_duration(F.col("started_at"), F.col("ended_at"))
    return d.trips().where(keep).select("trip_id", "started_at", "ended_at", "start_station_name")


@query("clean_station_names", """
    select name, count(*) n from (select trim(regexp_replace('  ' || replace(p_name, ' ', '   ') || chr(9) || ' ' || p_brand || ' ', '\\s+', ' ', 'g')) name from part) group by 1""")
def _(d: Data):
    raw = F.concat(F.lit("  "), F.replace(F.col("p_name"), F.lit(" "), F.lit("   ")), F.lit("\t "), F.col("p_brand"), F.lit(" "))
    return d.table("part").select(c.clean_name(raw).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("valid_station_names", """
    select p_partkey, name from (select p_partkey, p_name || case p_size % 8 when 0 then '<b>' when 1 then '--x' when 2 then ';' when 3 then '{' when 4 then '-' else '' end as name from part)
    where not regexp_matches(name, '[<>{};]') and not contains(name, '--')""")
def _(d: Data):
    mark = F.col("p_size") % 8
    tail = F.when(mark == 0, "<b>").when(mark == 1, "--x").when(mark == 2, ";").when(mark == 3, "{").when(mark == 4, "-").otherwise("")
    return d.table("part").select("p_partkey", F.concat("p_name", tail).alias("name")).where(c.valid_name(F.col("name")))


@query("parsed_times", """select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderdate end as parsed from orders""")
def _(d: Data):
    text = F.when(F.col("o_orderkey") % 5 == 0, "no time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return d.table("orders").select("o_orderkey", c.to_ts(text).alias("parsed"))


@query("naive_utc_hours", """select date_trunc('hour', ts - interval 5 hour) as hour, count(*) n from events group by 1""")
def _(d: Data):
    """Times with a zone (+05:00) brought to UTC without zone."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+05:00"))
    return d.table("events").groupBy(c.hour_bin(c.to_naive_utc(text.cast("timestamp"))).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("filtered_hourly", """
    select date_trunc('hour', started_at) as hour, count(*) trip_count from trips
    group by 1 having hour >= timestamp '2024-01-05' and hour <= timestamp '2024-01-20' and dayname(hour) in ('Monday','Tuesday','Saturday')""", "trips")
def _(d: Data):
    return dashboards.filter_hourly(rollups.hourly_demand(d.trips()), "2024-01-05", "2024-01-20", "Monday,Tuesday,Saturday")


@query("kept_station_trips", """
    select trip_id, start_station_name from trips where start_station_name in (
      select start_station_name from trips group by 1 order by count(*) desc, 1 limit 20)""", "trips")
def _(d: Data):
    t = d.trips().select("trip_id", "start_station_name")
    return c.keep_stations(t, ranking.top_by_rows(t, "start_station_name", 20), "start_station_name")


@query("stations_with_volume", """
    with v as (select start_station_name station_name, count(*) trip_count from trips group by 1), s as (select ceil(max(trip_count)/100E0) step from v)
    select station_name, trip_count, cast(step as bigint) step from v, s where trip_count >= 10*step""", "trips")
def _(d: Data):
    v = d.trips().groupBy(F.col("start_station_name").alias("station_name")).agg(F.count(F.lit(1)).alias("trip_count"))
    step = v.agg(c.volume_step(F.col("trip_count")).cast("long")).scalar()
    return v.withColumn("step", step).where(F.col("trip_count") >= 10 * F.col("step"))


@query("station_search", "select station_name from stations where contains(lower(station_name), lower('TION 1'))", "stations")
def _(d: Data):
    return d.stations().where(c.search(F.col("station_name"), "TION 1")).select("station_name")


@query("other_routes", "select start_station_name, end_station_name, count(*) trip_count from trips group by 1,2 having not (start_station_name = 'station 1' and end_station_name = 'station 2')", "trips")
def _(d: Data):
    chosen = d.trips().where("start_station_name = 'station 1' and end_station_name = 'station 2'")
    return c.exclude(rollups.routes(d.trips()), chosen.distinct(), ["start_station_name", "end_station_name"])


@query("weather_constant_fill", "select time, round(coalesce(temp,15.0),6) temp, round(coalesce(prcp,0.0),6) prcp, round(coalesce(wspd,5.0),6) wspd from weather", "weather")
def _(d: Data):
    return rounded(c.fill_const(d.weather(), {"temp": 15.0, "prcp": 0.0, "wspd": 5.0}))


@query("weather_median_fill", """
    select time, round(coalesce(temp,(select quantile_cont(temp,0.5) from weather)),6) temp, round(coalesce(wspd,(select quantile_cont(wspd,0.5) from weather)),6) wspd from weather""", "weather")
def _(d: Data):
    return rounded(quantiles.fill_median(d.weather().select("time", "temp", "wspd"), ["temp", "wspd"]))


@query("complete_weather", "select time, round(temp,6) temp, round(wspd,6) wspd from weather where temp is not null and wspd is not null", "weather")
def _(d: Data):
    return rounded(c.drop_nulls(d.weather().select("time", "temp", "wspd"), ["temp", "wspd"]))


@query("clipped_weather", "select time, round(case when wspd is not null then greatest(0.0, least(12.0, wspd)) end,6) wspd, round(case when temp > 9.5 then 9.5 else temp end,6) temp from weather", "weather")
def _(d: Data):
    return rounded(d.weather().select("time", c.clip(F.col("wspd"), 0.0, 12.0).alias("wspd"), c.clip(F.col("temp"), None, 9.5).alias("temp")))


@query("numbers_or_zero", "select p_partkey, coalesce(try_cast(case when p_size % 3 = 0 then p_brand else cast(p_size as varchar) end as double),0) v from part")
def _(d: Data):
    text = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return d.table("part").select("p_partkey", c.to_number0(text).alias("v"))


@query("aligned_columns", "select cast(o_totalprice as double) o_totalprice, 0E0 absent, cast(o_orderkey as double) o_orderkey from orders")
def _(d: Data):
    return c.align_features(d.table("orders"), ["o_totalprice", "absent", "o_orderkey"])


@query("station_traffic_mode", """
    select start_station_name, case when sum(case when isodow(started_at)>=6 then 1 else 0 end)*100E0/count(*) > 30 then 'Leisure' else 'Commute' end traffic from trips group by 1""", "trips")
def _(d: Data):
    return dashboards.weekend_share(d.trips()).select("start_station_name", c.traffic_mode(F.col("weekend_share")).alias("traffic"))


@query("rounding_modes", """
    select l_orderkey, l_linenumber, round_even(l_quantity/4, 0) half_even, floor(l_quantity/4 + 0.5) half_up, trunc(5 - l_quantity/4) cut, abs(5 - l_quantity) size, ceil(l_quantity/4) up from lineitem""")
def _(d: Data):
    x = F.col("l_quantity") / 4
    return d.table("lineitem").select("l_orderkey", "l_linenumber", c.round_half_even(x).alias("half_even"), c.round_half_up(x).cast("double").alias("half_up"),
                                      c.truncate(5 - x).cast("double").alias("cut"), F.abs(5 - F.col("l_quantity")).alias("size"), F.ceil(x).cast("double").alias("up"))


@query("label_fallback", """
    select p_partkey, coalesce(nullif(case when p_size % 4 = 0 then '' when p_size % 4 = 1 then null else p_brand end, ''), p_name) label,
           coalesce(nullif(case when p_size % 3 = 0 then 0E0 when p_size % 3 = 1 then null else p_size/50E0 end, 0), 0.85) score from part""")
def _(d: Data):
    size = F.col("p_size")
    brand = F.when(size % 4 == 0, "").when(size % 4 == 1, None).otherwise(F.col("p_brand"))
    score = F.when(size % 3 == 0, 0.0).when(size % 3 == 1, None).otherwise(size / 50.0)
    return d.table("part").select("p_partkey", c.first_present(brand, F.col("p_name")).alias("label"), F.coalesce(c.falsy_to_null(score), F.lit(0.85)).alias("score"))


# ------------------------------------------------------------------------------------------------------ rollups

@query("hourly_net_demand", "select * from hourly", "hourly")
def _(d: Data):
    return rollups.station_hourly(d.trips())


@query("pickups_full_join_dropoffs", "select * from hourly", "hourly")
def _(d: Data):
    t = d.trips()
    ups = t.groupBy(F.col("start_station_name").alias("station_name"), c.hour_bin(F.col("started_at")).alias("time")).agg(F.count(F.lit(1)).alias("pickups"))
    downs = t.groupBy(F.col("end_station_name").alias("station_name"), c.hour_bin(F.col("ended_at")).alias("time")).agg(F.count(F.lit(1)).alias("dropoffs"))
    return joins.pickups_join_dropoffs(ups, downs)


@query("hourly_demand", "select date_trunc('hour', started_at) as hour, count(*) trip_count from trips group by 1", "trips")
def _(d: Data):
    return rollups.hourly_demand(d.trips())


@query("daily_demand", "select dayname(started_at) day_of_week, member_casual, count(*) trip_count from trips group by 1,2", "trips")
def _(d: Data):
    return rollups.daily_demand(d.trips())


@query("station_hourly_demand", "select start_station_name, dayname(started_at) day_of_week, hour(started_at)::int as hour, count(*) trip_count from trips group by 1,2,3", "trips")
def _(d: Data):
    return rollups.station_hourly_demand(d.trips())


@query("demand_rollups", """
    select date_trunc('hour', started_at) as time, null day_of_week, null member_casual, null start_station_name, null::int as hour, count(*) trip_count, 'hourly' as level from trips group by 1
    union all select null, dayname(started_at), member_casual, null, null, count(*), 'daily' from trips group by 2,3
    union all select null, dayname(started_at), null, start_station_name, hour(started_at)::int, count(*), 'station' from trips group by 2,4,5""", "trips")
def _(d: Data):
    return rollups.demand_rollups(d.trips())


@query("top_routes", "select start_station_name, end_station_name, count(*) trip_count from trips group by 1,2 order by 3 desc, 1, 2 limit 200", "trips")
def _(d: Data):
    return rollups.top_routes(d.trips(), 200)


@query("nation_flows", """
    select s.s_nationkey origin, cu.c_nationkey destination, count(*) trip_count from lineitem join supplier s on l_suppkey = s_suppkey
    join orders on l_orderkey = o_orderkey join customer cu on o_custkey = c_custkey group by 1,2""")
def _(d: Data):
    """Flow matrix from four tables; the flows are counted per customer before the customer table is joined."""
    flows = (d.table("lineitem").select("l_orderkey", "l_suppkey").join(d.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
             .join(d.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
             .groupBy("o_custkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n")))
    return (flows.join(d.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("s_nationkey").alias("origin"), F.col("c_nationkey").alias("destination")).agg(F.sum("n").alias("trip_count")))


@query("station_quality", """
    select station_name, data_points, volume::bigint volume, round(mean,6) mean, round(std,6) std, first_time, last_time, round(days_active,6) days_active,
           round(coverage,6) coverage, round(cv,6) cv, round(score,6) score from quality""", "quality")
def _(d: Data):
    return rounded(rollups.station_quality(rollups.station_hourly(d.trips())))


@query("station_quality_net", """
    select station_name, data_points, round(volume*coverage/(cv+1),6) score from (
      select *, std/(mean+1E-6) cv, least(1.0, greatest(0.0, data_points/(active*24+1))) coverage from (
        select station_name, count(*) data_points, sum(abs(net_demand)) volume, avg(abs(net_demand)) mean, stddev_samp(abs(net_demand)) std,
               date_diff('second', min(time), max(time))/86400E0 active from hourly group by 1))""", "hourly")
def _(d: Data):
    return rounded(rollups.station_quality(rollups.station_hourly(d.trips()), absolute=True).select("station_name", "data_points", "score"))


@query("best_stations", "select station_name, round(score,6) score from quality where score is not null order by quality.score desc, station_name limit 50", "quality")
def _(d: Data):
    return rounded(rollups.top_stations(rollups.station_quality(rollups.station_hourly(d.trips())), 50).select("station_name", "score"))


@query("station_metadata", "select station_name, round(avg(pickups),6) mean_demand, round(coalesce(stddev_samp(pickups),1.0),6) std_demand, max(pickups) max_demand from hourly group by 1", "hourly")
def _(d: Data):
    return rounded(rollups.station_metadata(rollups.station_hourly(d.trips())))


@query("daily_weather", "select cast(time as date) date, round(avg(temp),6) temp, round(sum(prcp),6) prcp from weather group by 1", "weather")
def _(d: Data):
    return rounded(rollups.daily_weather(d.weather()))


@query("demand_profile", """
    select 'hour' as level, hour(time)::int slot, round(avg(pickups),6) mean_demand from hourly group by 2
    union all select 'weekday', (isodow(time)-1)::int, round(avg(pickups),6) from hourly group by 2
    union all select 'month', month(time)::int, round(avg(pickups),6) from hourly group by 2""", "hourly")
def _(d: Data):
    return rounded(rollups.demand_profile(rollups.station_hourly(d.trips())))


@query("weekly_pattern", "select dayname(time) day_name, case when isodow(time)>=6 then 1 else 0 end is_weekend, round(avg(pickups),6) pickups from hourly group by 1,2", "hourly")
def _(d: Data):
    return rounded(rollups.weekly_pattern(rollups.station_hourly(d.trips())))


@query("station_baselines", """
    with b as (select station_name, hour(time)::int as hour, (isodow(time)-1)::int dow, pickups from hourly where time < timestamp '2024-01-25')
    select c.station_name, c.hour, c.dow, round(h.m,6) station_avg_hourly, round(w.m,6) station_avg_dow, round(p.s/(select sum(pickups) from b),6) popularity
    from (select distinct station_name, hour, dow from b) c join (select station_name, hour, avg(pickups) m from b group by 1,2) h on h.station_name=c.station_name and h.hour=c.hour
    join (select station_name, dow, avg(pickups) m from b group by 1,2) w on w.station_name=c.station_name and w.dow=c.dow
    join (select station_name, sum(pickups) s from b group by 1) p on p.station_name=c.station_name""", "hourly")
def _(d: Data):
    return rounded(rollups.station_baselines(rollups.station_hourly(d.trips()), F.col("time") < F.lit("2024-01-25").cast("timestamp_ntz")))


@query("trip_profile", """
    select count(*) n_rows, min(started_at) first_time, max(started_at) last_time, date_diff('day', min(started_at)::date, max(started_at)::date)::int span_days,
           count(*) filter (start_station_name is null) start_station_name_nulls, count(*) filter (end_station_name is null) end_station_name_nulls,
           count(*) filter (ended_at is null) ended_at_nulls, count(distinct start_station_name) n_start_stations, count(distinct end_station_name) n_end_stations from trips""", "trips")
def _(d: Data):
    return rollups.profile(d.trips())


@query("price_description", """
    select count(o_totalprice) n, round(avg(o_totalprice),4) mean, round(stddev_samp(o_totalprice),4) std, min(o_totalprice) "min", max(o_totalprice) "max",
           round(quantile_cont(o_totalprice,0.25),4) q25, round(quantile_cont(o_totalprice,0.5),4) q50, round(quantile_cont(o_totalprice,0.75),4) q75 from orders""")
def _(d: Data):
    return rounded(quantiles.describe(d.table("orders"), "o_totalprice"), 4)


@query("stations_by_rows", "select start_station_name, count(*) n_rows from trips group by 1 order by 2 desc, 1 limit 15", "trips")
def _(d: Data):
    return ranking.top_by_rows(d.trips(), "start_station_name", 15)


@query("distinct_stations", "select distinct start_station_name from trips", "trips")
def _(d: Data):
    return d.trips().select("start_station_name").distinct()


@query("first_trip_of_station", "select start_station_name, arg_min(trip_id, (started_at, trip_id)) trip_id, min(started_at) started_at from trips group by 1", "trips")
def _(d: Data):
    return ranking.dedup_first(d.trips().select("start_station_name", "trip_id", "started_at"), ["start_station_name"], ["started_at", "trip_id"])


@query("price_histogram", """
    with e as (select min(o_totalprice) lo, max(o_totalprice) hi from orders)
    select least(49, cast(floor((o_totalprice-lo)/((hi-lo)/50)) as bigint)) bin, count(*) n from orders, e group by 1""")
def _(d: Data):
    return quantiles.histogram(d.table("orders"), "o_totalprice", 50)


@query("all_stations_seen", "select station_name, sum(n)::bigint n from (select start_station_name station_name, 1 n from trips union all select end_station_name, 1 from trips) group by 1", "trips")
def _(d: Data):
    t = d.trips()
    both = ranking.union_all(t.select(F.col("start_station_name").alias("station_name")), t.select(F.col("end_station_name").alias("station_name")))
    return both.groupBy("station_name").agg(F.count(F.lit(1)).alias("n"))


@query("stations_never_ended_at", "select distinct start_station_name station_name from trips except select end_station_name from trips", "trips")
def _(d: Data):
    t = d.trips()
    return t.select(F.col("start_station_name").alias("station_name")).distinct().join(
        t.select(F.col("end_station_name").alias("station_name")).distinct(), "station_name", "left_anti")


@query("csv_lines_with_faults", """
    select case when trip_id % 50 = 0 then null else trip_id end trip_id, start_station_name, case when trip_id % 50 = 0 then 'x' || trip_id || ',' || start_station_name end bad_line from trips""", "trips")
def _(d: Data):
    """Trips as CSV with a number that is none in one line of fifty: such lines are kept as text."""
    path = stage_path(d.spark, "faulty-csv")
    number = F.when(F.col("trip_id") % 50 == 0, F.concat(F.lit("x"), F.col("trip_id").cast("string"))).otherwise(F.col("trip_id").cast("string"))
    sinks.write_csv(d.trips().select(number.alias("trip_id"), "start_station_name"), path)
    schema = schemas.T.StructType([f for f in schemas.TRIPS.fields if f.name in ("trip_id", "start_station_name")])
    return files.read_csv(d.spark, [path], schema, corrupt="bad_line")


@query("sampled_trips", "select * from trips where substr(md5('42|' || trip_id), 1, 8) < '1999999a'", "trips")
def _(d: Data):
    return ranking.sample_fraction(d.trips(), ["trip_id"], 0.1)


@query("sampled_trip_rows", "select * from trips order by md5('42|' || trip_id), trip_id limit 5000", "trips")
def _(d: Data):
    return ranking.sample_rows(d.trips(), ["trip_id"], 5000)


@query("sampled_station_dates", """
    select station_name, unnest([date '2024-01-10', date '2024-04-10', date '2024-07-10', date '2024-10-10']) date
    from (select distinct station_name from hourly order by md5('42|' || station_name), station_name limit 20)""", "hourly")
def _(d: Data):
    return ranking.sample_station_dates(rollups.station_hourly(d.trips()), 20, ["2024-01-10", "2024-04-10", "2024-07-10", "2024-10-10"])
