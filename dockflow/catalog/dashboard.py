"""Queries on dashboards, operations and spatial summaries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.catalog.base import Data, STATUS_ORDER, VIEWS, query, rounded
from dockflow.operators import joins, ranking, rollups, spatial
from dockflow.plans import dashboards, operations
from dockflow.plans import feature_table as ft
from dockflow.session import stage_path
from dockflow.sources import sinks

START, END, DAYS = "1996-01-01", "1999-06-30", "Monday,Tuesday,Wednesday,Saturday,Sunday"

VIEWS["overview_base"] = (("order_days",), f"""
    select * from order_days where hour >= timestamp '{START}' and hour <= timestamp '{END}' and dayname(hour) in ('{"','".join(DAYS.split(","))}')""")
VIEWS["overview_daily"] = (("overview_base",), """
    select cast(d as date) date, coalesce(n,0)::bigint trip_count from
      (select unnest(range(min(cast(hour as date)), max(cast(hour as date)) + interval 1 day, interval 1 day)) d from overview_base)
      left join (select cast(hour as date) dd, sum(trip_count) n from overview_base group by 1) on dd = cast(d as date)""")
VIEWS["volumes"] = (("trips",), "select start_station_name station_name, count(*) trip_count from trips group by 1")
VIEWS["profile"] = (("trips",), "select start_station_name, dayname(started_at) day_of_week, hour(started_at)::int as hour, count(*) trip_count from trips group by 1,2,3")


def overview(d: Data):
    """Overview of orders by day: long enough for trends, with gaps where weekdays are filtered out."""
    base = dashboards.filter_hourly(d.order_days(), START, END, DAYS)
    from dockflow.operators.series import daily_series
    return base, daily_series(base)


@query("overview_kpis", """
    with k as (select sum(trip_count)::bigint total, sum(case when isodow(hour)>=6 then trip_count else 0 end) w from overview_base),
    p as (select hour(hour)::int h from overview_base group by 1 order by sum(trip_count) desc, 1 limit 1),
    e as (select avg(trip_count) filter (isodow(date)>=6) a, avg(trip_count) filter (isodow(date)<6) b, stddev_samp(trip_count) filter (isodow(date)>=6) s,
                 stddev_samp(trip_count) filter (isodow(date)<6) t from overview_daily)
    select total total_trips, round_even(w/total*100, 2) weekend_share, h peak_hour, round_even((a-b)/sqrt((s*s+t*t)/2), 2) weekend_effect, null::varchar message from k, p, e""", "overview_base", "overview_daily")
def _(d: Data):
    return dashboards.overview_kpis(overview(d)[0])


@query("event_overview_kpis", """
    with b as (select date_trunc('hour', started_at) as hour, count(*) trip_count from trips group by 1),
    k as (select sum(trip_count)::bigint total, sum(case when isodow(hour)>=6 then trip_count else 0 end) w from b),
    p as (select hour(hour)::int h from b group by 1 order by sum(trip_count) desc, 1 limit 1),
    dd as (select hour::date date, sum(trip_count) trip_count from b group by 1),
    e as (select avg(trip_count) filter (isodow(date)>=6) a, avg(trip_count) filter (isodow(date)<6) b, stddev_samp(trip_count) filter (isodow(date)>=6) s,
                 stddev_samp(trip_count) filter (isodow(date)<6) t from dd)
    select total total_trips, round_even(w/total*100, 2) weekend_share, h peak_hour, round_even((a-b)/sqrt((s*s+t*t)/2), 2) weekend_effect, null::varchar message from k, p, e""", "trips")
def _(d: Data):
    return dashboards.overview_kpis(rollups.hourly_demand(d.trips()))


@query("empty_overview_kpis", f"""
    select count(*)::bigint total_trips, 0E0 weekend_share, 0 peak_hour, 0E0 weekend_effect, '{dashboards.EMPTY_MESSAGE}' message from orders where o_orderdate > timestamp '2090-01-01'""")
def _(d: Data):
    return dashboards.overview_kpis(dashboards.filter_hourly(d.order_days(), "2090-01-01", None, None))


@query("overview_series", """
    select o.date, trip_count, round(temp,6) temp, round(w.prcp,6) precip,
           case when w.date is null then null else greatest(30, least(100, 55 + case when w.prcp>0 then 25 else 0 end + date_diff('day', date '1970-01-01', w.date)%20)) end::int humidity
    from overview_daily o left join day_weather w on w.date = o.date""", "overview_daily", "day_weather")
def _(d: Data):
    return rounded(dashboards.overview_series(overview(d)[1], d.day_weather()))


@query("overview_trend", """
    with t as (select date, count(*) over w n, avg(trip_count) over w m, stddev_samp(trip_count) over w s from overview_daily window w as (order by date rows between 6 preceding and current row))
    select date, round(case when n=7 then m else 0 end,6) ma, round(case when n=7 then m+1.96*s else 0 end,6) upper_ci, round(case when n=7 then m-1.96*s else 0 end,6) lower_ci from t""", "overview_daily")
def _(d: Data):
    from dockflow.operators.series import trend_band
    return rounded(trend_band(overview(d)[1]))


@query("overview_anomalies", """
    with m as (select avg(trip_count) a, stddev_samp(trip_count) s from overview_daily)
    select o.date, trip_count, round_even((trip_count-a)/s, 2) z_score, round(temp,6) temp, round(w.prcp,6) precip
    from m, overview_daily o left join day_weather w on w.date = o.date where abs((trip_count-a)/s) > 2""", "overview_daily", "day_weather")
def _(d: Data):
    return rounded(dashboards.overview_anomalies(overview(d)[1], d.day_weather()))


@query("rider_heatmap", """
    select dayname(started_at) day_of_week, sum(case when member_casual='casual' then 1 end)::bigint casual, sum(case when member_casual='member' then 1 end)::bigint member from trips group by 1""", "trips")
def _(d: Data):
    return dashboards.rider_heatmap(rollups.daily_demand(d.trips()))


@query("station_kpis", """
    with h as (select start_station_name, hour, sum(trip_count) n from profile group by 1,2)
    select start_station_name, sum(n)::bigint total_trips, floor(sum(n)/7)::bigint avg_trips_day, arg_max(hour, (n, -hour)) peak_hour from h group by 1""", "profile")
def _(d: Data):
    return dashboards.station_kpis(rollups.station_hourly_demand(d.trips()))


def long_form(parts: dict[str, tuple[DataFrame, str | None, list[str]]]) -> DataFrame:
    """Several small tables as (part, item, name, value): one row for each of the named columns of each row; ``item`` is the row's key."""
    out = None
    for part, (df, key, columns) in parts.items():
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
        rows = df.select(F.lit(part).alias("part"), (F.col(key).cast("string") if key else F.lit("")).alias("item"), cells.alias("c")).select("part", "item", "c.*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("station_detail", """
    with b as (select start_station_name s from trips group by 1 order by count(*) desc, 1 limit 1), p as (select profile.* from profile, b where start_station_name = s),
    h as (select hour, sum(trip_count) n from p group by 1),
    t as (select sum(n)::double total, floor(sum(n)/7)::double a, arg_max(hour, (n, -hour))::double peak from h),
    d as (select unnest(['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']) wd)
    select 'kpis' part, '' item, unnest(['total_trips','avg_trips_day','peak_hour']) "name", unnest([total, a, peak]) "value" from t
    union all select 'hourly_profile', hour::varchar, 'trip_count', round(avg(trip_count),6) from p group by hour
    union all select 'daily_profile', wd, 'trip_count', (select sum(trip_count)::double from p where day_of_week = wd) from d
    union all select 'location', '', unnest(['lat','lon']), unnest([lat, lon]) from stations, b where station_name = s""", "trips", "profile", "stations")
def _(d: Data):
    """All parts of the busiest station's page."""
    trips = d.trips()
    busiest = ranking.top_by_rows(trips, "start_station_name", 1).first()["start_station_name"]
    x = dashboards.station_detail(rollups.station_hourly_demand(trips), d.stations(), busiest)
    return rounded(long_form({"kpis": (x["kpis"], None, ["total_trips", "avg_trips_day", "peak_hour"]), "hourly_profile": (x["hourly_profile"], "hour", ["trip_count"]),
                              "daily_profile": (x["daily_profile"], "day_of_week", ["trip_count"]), "location": (x["location"], None, ["lat", "lon"])}))


@query("system_overview", """
    with z as (select date, trip_count, (trip_count - avg(trip_count) over ()) / nullif(stddev_samp(trip_count) over (), 0) z from overview_daily)
    select 'kpis' part, '' item, 'total_trips' "name", (select sum(trip_count)::double from overview_base) "value"
    union all select 'kpis', '', 'peak_hour', (select hour(hour)::double from overview_base group by hour(hour) order by sum(trip_count) desc, hour(hour) limit 1)
    union all select 'time_series', date::varchar, 'trip_count', trip_count::double from overview_daily
    union all select 'anomalies', date::varchar, 'z_score', round_even(z, 2) from z where abs(z) > 2
    union all select 'heatmap', dayname(started_at), case member_casual when 'casual' then 'casual' else 'member' end, count(*)::double from trips group by 1, 2, 3""", "overview_base", "overview_daily", "trips")
def _(d: Data):
    """The parts of the overview page, from one call."""
    x = dashboards.system_overview(d.order_days(), rollups.daily_demand(d.trips()), d.day_weather(), START, END, DAYS)
    parts = {"kpis": (x["kpis"], None, ["total_trips", "peak_hour"]), "time_series": (x["time_series"], "date", ["trip_count"]), "anomalies": (x["anomalies"], "date", ["z_score"]),
             "heatmap": (x["heatmap"], "day_of_week", ["casual", "member"])}
    return rounded(long_form(parts).where("part <> 'heatmap' or value is not null"))


@query("station_hour_profile", "select start_station_name, hour, round(avg(trip_count),6) trip_count from profile group by 1,2", "profile")
def _(d: Data):
    return rounded(dashboards.station_hour_profile(rollups.station_hourly_demand(d.trips())))


@query("station_day_profile", """
    select s.start_station_name, i::int day_index, dn day_of_week, n::bigint trip_count from (select distinct start_station_name from profile) s
    cross join (values (0,'Monday'),(1,'Tuesday'),(2,'Wednesday'),(3,'Thursday'),(4,'Friday'),(5,'Saturday'),(6,'Sunday')) w(i, dn)
    left join (select start_station_name, day_of_week, sum(trip_count) n from profile group by 1,2) p on p.start_station_name=s.start_station_name and p.day_of_week=dn""", "profile")
def _(d: Data):
    return dashboards.station_day_profile(rollups.station_hourly_demand(d.trips()))


@query("map_data", """
    select s.station_name, lat, lon, coalesce(trip_count,0) trip_count from stations s left join volumes v on v.station_name=s.station_name
    order by 4 desc, 1 limit 1000""", "stations", "volumes")
def _(d: Data):
    volumes = d.trips().groupBy(F.col("start_station_name").alias("station_name")).agg(F.count(F.lit(1)).alias("trip_count"))
    return dashboards.map_data(d.stations(), volumes)


@query("route_data", """
    with r as (select start_station_name, end_station_name, count(*) trip_count from trips group by 1,2 order by 3 desc, 1, 2 limit 50)
    select r.*, a.lat start_lat, a.lon start_lon, b.lat end_lat, b.lon end_lon from r join s a on a.station_name = start_station_name join s b on b.station_name = end_station_name""".replace(
    "with r as", "with s as (select * from stations), r as"), "trips", "stations")
def _(d: Data):
    return dashboards.route_data(d.trips(), d.stations(), 50)


@query("station_list", "select station_name from stations order by 1", "stations")
def _(d: Data):
    return dashboards.station_list(d.stations())


@query("historical_demand", """
    select strftime(time, '%Y-%m-%dT%H:%M:%S') || '+00:00' date, pickups::double demand from hourly
    where station_name = (select station_name from hourly group by 1 order by count(*) desc, 1 limit 1) and time >= timestamp '2024-01-03' and time <= timestamp '2024-01-28'""", "hourly")
def _(d: Data):
    """Served from the published history: one bucket is read and no trip."""
    path = stage_path(d.spark, "history")
    sinks.write_buckets(rollups.station_hourly(d.trips()), path)
    history = sinks.open_buckets(d.spark, path)
    busiest = ranking.top_by_rows(history, "station_name", 1).first()["station_name"]
    return dashboards.historical_demand(history, busiest, "2024-01-03", "2024-01-28")


VIEWS["boroughs"] = ((), """
    select case r_name when 'AFRICA' then 'Bronx' when 'AMERICA' then 'Manhattan' when 'EUROPE' then 'Queens' else r_name end borough,
      count(*)/(select count(*)/4E0 from supplier) score
    from region join nation on r_regionkey=n_regionkey join supplier on s_nationkey=n_nationkey group by r_name""")


def boroughs(d: Data):
    name = F.when(F.col("r_name") == "AFRICA", "Bronx").when(F.col("r_name") == "AMERICA", "Manhattan").when(F.col("r_name") == "EUROPE", "Queens").otherwise(F.col("r_name"))
    per_nation = d.table("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    total = d.table("supplier").agg((F.count(F.lit(1)) / 4.0).alias("t")).scalar()
    return (d.table("region").join(d.table("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
            .join(per_nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.sum("n").alias("n"))
            .select(name.alias("borough"), (F.col("n") / total).alias("score")))


@query("service_level", """
    with d(borough, score) as (values ('Manhattan',0.92),('Brooklyn',0.87),('Queens',0.78),('Bronx',0.71),('Staten Island',0.65)),
    m as (select coalesce(b.borough, d.borough) borough, coalesce(nullif(b.score,0), d.score, b.score)::double score from boroughs b full join d on b.borough = d.borough)
    select borough, round(score,6) score, case when score>=0.9 then 'green' when score>=0.8 then 'amber' else 'red' end as level, case when score<0.8 then 1 else 0 end intervention from m""", "boroughs")
def _(d: Data):
    return rounded(dashboards.service_level(boroughs(d), dashboards.default_scores(d.spark)))


# ------------------------------------------------------------------------------------------------------ operations

VIEWS["latest_status"] = (("station_status",), "select * from station_status qualify row_number() over (partition by station_id order by last_reported desc, ord desc, ebikes desc, bikes desc, docks desc) = 1")
VIEWS["live"] = (("latest_status", "station_info"), """
    select i.station_id, i.name, i.capacity, l.bikes, l.ebikes, l.docks, l.is_renting = 1 is_renting, l.last_reported
    from station_info i join latest_status l on l.station_id = i.station_id""")


def board_sql(whole: str) -> str:
    return f"""
    with b as (select station_id, name, bikes, docks, cap capacity, bikes/cap fill from (
        select *, case when capacity > 0 then capacity when bikes + docks > 0 then bikes + docks else 30 end cap from live)),
    c as (select *, case when fill<0.15 then 'RESTOCK' when fill>0.85 then 'PICKUP' when fill<0.25 then 'RESTOCK' when fill>0.75 then 'PICKUP' else 'HOLD' end action,
        {whole}(case when fill<0.15 then capacity*0.4E0-bikes when fill>0.85 then bikes-capacity*0.6E0 when fill<0.25 then capacity*0.35E0-bikes when fill>0.75 then bikes-capacity*0.65E0 else 0 end)::bigint q,
        case when fill<0.05 or fill>0.95 then 'CRITICAL' when fill<0.15 or fill>0.85 then 'HIGH' when fill<0.25 or fill>0.75 then 'MEDIUM' else 'LOW' end priority from b),
    a as (select station_id, name, action, least(q,15) quantity, priority, bikes current_bikes, docks current_docks, capacity, round_even(fill*100,0)::bigint fill_pct from c where action<>'HOLD' and q>0)
    """


def live(d: Data):
    return operations.station_state(d.station_info(), d.station_status(), STATUS_ORDER)


@query("live_stations", """
    select i.station_id, i.name, i.capacity, l.bikes, l.ebikes, l.docks, l.is_renting = 1 is_renting, l.last_reported,
      round(case when capacity>0 then (l.bikes+l.ebikes)/capacity else 0 end,6) fill_rate_sum, round(case when capacity>0 then l.bikes/capacity else 0 end,6) fill_rate
    from station_info i join latest_status l on l.station_id = i.station_id""", "station_info", "latest_status")
def _(d: Data):
    return rounded(operations.station_state(d.station_info(), d.station_status(), STATUS_ORDER))


@query("rebalancing_actions", board_sql("trunc") + "select * from a", "live")
def _(d: Data):
    return operations.rebalancing_actions(live(d))


@query("rebalancing_actions_ceil", board_sql("ceil") + "select * from a", "live")
def _(d: Data):
    return operations.rebalancing_actions(live(d), "ceil")


@query("rebalancing_actions_uncut", board_sql("trunc").replace("least(q,15) quantity", "q quantity") + "select *, false cut from a", "live")
def _(d: Data):
    return operations.rebalancing_actions(live(d), per_trip=None, mark="cut")


@query("rebalancing_actions_marked", board_sql("trunc").replace("least(q,15) quantity", "least(q,15) quantity, q > 15 cut") + "select * from a", "live")
def _(d: Data):
    return operations.rebalancing_actions(live(d), mark="cut")


@query("rebalancing_board", board_sql("trunc") + "select * from a order by case priority when 'CRITICAL' then 0 when 'HIGH' then 1 when 'MEDIUM' then 2 else 3 end, station_id limit 50", "live")
def _(d: Data):
    return operations.action_board(operations.rebalancing_actions(live(d)))


@query("fleet_kpis", board_sql("trunc") + """select count(*) pending, count(*) filter (priority='CRITICAL') critical, sum(quantity)::bigint bikes_to_move,
    greatest(0, 100 - 5*count(*) filter (priority='CRITICAL') - 2*count(*) filter (priority='HIGH'))::bigint health from a""", "live")
def _(d: Data):
    return operations.fleet_kpis(operations.rebalancing_actions(live(d)))


@query("undispatched_actions", board_sql("trunc") + "select * from a where station_id not in (select station_id from latest_status where is_renting = 0)", "live")
def _(d: Data):
    done = ranking.latest(d.station_status(), ["station_id"], STATUS_ORDER).where("is_renting = 0")
    return operations.dispatch(operations.rebalancing_actions(live(d)), done)


# ------------------------------------------------------------------------------------------------------ spatial

@query("stations_near_points", """
    select point_id centre_id, station_name from points p join stations s on abs(s.lon-p.lon) < 0.003 and abs(s.lat-p.lat) < 0.003""", "points", "stations")
def _(d: Data):
    return spatial.stations_near(d.points().withColumnRenamed("point_id", "centre_id"), d.stations(), 0.003)


@query("nearest_station", """
    select point_id, arg_min(station_name, (d2, station_name)) station_name, round(sqrt(min(d2)),9) dist from (
      select point_id, station_name, pow(s.lon-p.lon,2)+pow(s.lat-p.lat,2) d2 from points p cross join stations s) group by 1""", "points", "stations")
def _(d: Data):
    return rounded(spatial.nearest_station(d.points(), d.stations()), 9)


@query("match_by_volume", """
    with t as (select distinct weight::double target from points where weight > 0), m as (
      select target, arg_min(station_name, (abs(trip_count-target), trip_count, station_name)) station_name, min(abs(trip_count-target))::double diff from t cross join volumes group by 1)
    select target, case when diff < target*0.1 then station_name end station_name, case when diff < target*0.1 then diff end diff from m""", "points", "volumes")
def _(d: Data):
    volumes = d.trips().groupBy(F.col("start_station_name").alias("station_name")).agg(F.count(F.lit(1)).alias("trip_count"))
    return spatial.match_by_volume(d.points().where("weight > 0").select(F.col("weight").alias("target")), volumes)


@query("hexagons", """
    with q as (select weight, kind, (sqrt(3)/3*x - 1/3E0*y)/200 q, (2/3E0*y)/200 r from (select weight, kind, lon*(111320*cos(radians(40.7))) x, lat*111320 y from points)),
    c as (select *, floor(q+0.5) rq, floor(r+0.5) rr, floor(-q-r+0.5) rs from q), e as (select *, abs(rq-q) dq, abs(rr-r) dr, abs(rs+q+r) ds from c)
    select (case when dq>dr and dq>ds then -rr-rs else rq end)::bigint hex_q, (case when dq>dr and dq>ds then rr when dr>ds then -rq-rs else rr end)::bigint hex_r,
      sum(weight)::bigint weight, count(*) n, count(distinct kind) n_stations from e group by 1,2""", "points")
def _(d: Data):
    return spatial.hexbin(d.points(), 200.0, names="kind")


@query("station_density", "select floor(lat/0.01)::bigint cell_y, floor(lon/0.01)::bigint cell_x, sum(trip_count)::bigint weight, count(*) n from stations join volumes using (station_name) group by 1,2", "stations", "volumes")
def _(d: Data):
    volumes = d.trips().groupBy(F.col("start_station_name").alias("station_name")).agg(F.count(F.lit(1)).alias("weight"))
    return spatial.density(joins.with_station(volumes, d.stations()), 0.01)


@query("grid_with_station_metrics", "select g.station_name, g.time, round(q.coverage,6) coverage from grid g left join quality q on q.station_name = g.station_name", "grid", "quality")
def _(d: Data):
    series = ft.kept_series(d.trips())
    from dockflow.operators.series import densify
    quality = rollups.station_quality(series).select("station_name", "coverage")
    return rounded(joins.with_station(densify(series, ["pickups"]).drop("pickups"), quality))
