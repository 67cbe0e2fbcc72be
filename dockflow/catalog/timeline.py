"""Queries on calendars, time series, features and model preparation."""

from pyspark.sql import functions as F

from dockflow.catalog.base import Data, VIEWS, query, rounded
from dockflow.functions import calendar as cal
from dockflow.functions import weather as wx
from dockflow.operators import preparation, quantiles, ranking, rollups, series
from dockflow.operators.joins import with_weather
from dockflow.plans import feature_table as ft
from dockflow.schemas import EMA_SPAN, FEATURES, LAGS, ROLLING
from dockflow.session import stage


def _cycle(expr: str, n: int, name: str) -> str:
    return f"round(sin(2*pi()*{expr}/{n}),6) {name}_sin, round(cos(2*pi()*{expr}/{n}),6) {name}_cos"


def calendar_sql(t: str) -> str:
    """Calendar features of an hour in the check dialect."""
    h, dow = f"hour({t})", f"(isodow({t})-1)"
    flag = lambda cond, name: f"case when {cond} then 1 else 0 end {name}"
    return ", ".join([
        f"{dow}::int day_of_week", flag(f"{dow}>=5", "is_weekend"), f"{h}::int as hour", f"day({t})::int as day", f"month({t})::int as month", f"year({t})::int as year",
        f"quarter({t})::int as quarter", _cycle(h, 24, "hour"), _cycle(f"month({t})", 12, "month"), _cycle(f"day({t})", 31, "day"),
        flag(f"{h} in (7,8,9)", "is_morning_rush"), flag(f"{h} in (17,18,19)", "is_evening_rush"), flag(f"{h} in (7,8,9,17,18,19)", "is_rush_hour"),
        flag(f"{h} between 9 and 17 and {dow}<5", "is_business_hours"),
        f"case when {h} between 5 and 11 then 1 when {h} between 12 and 16 then 2 when {h} between 17 and 20 then 3 else 4 end time_of_day",
        f"case when month({t}) in (12,1,2) then 1 when month({t}) in (3,4,5) then 2 when month({t}) in (6,7,8) then 3 else 4 end season",
        f"weekofyear({t})::int week_of_year", flag(f"day({t})<=3", "is_month_start"), flag(f"day({t})>=28", "is_month_end"),
        f"round(epoch({t} - timestamp '2020-01-01')/86400E0,6) days_since_epoch"])


NEAR = """
    (select d date, case when d in (select date from holidays) then 1 else 0 end is_holiday,
       least(30, coalesce(date_diff('day', d, (select min(date) from holidays where date > d)), 30))::int days_to_holiday,
       least(30, coalesce(date_diff('day', (select max(date) from holidays where date < d), d), 30))::int days_since_holiday from (select distinct {0}::date d from {1}))"""


# ------------------------------------------------------------------------------------------------------ calendar

@query("calendar_of_orders", f"select o_orderkey, {calendar_sql('o_orderdate')} from orders")
def _(d: Data):
    o = d.table("orders")
    return rounded(o.select("o_orderkey", *[c.alias(n) for n, c in cal.hour_columns(F.col("o_orderdate")).items()]))


@query("calendar_variants", """
    select ts, case when hour(ts)<6 then 0 when hour(ts)<12 then 1 when hour(ts)<18 then 2 else 3 end part_serve,
           case when hour(ts)<=6 then 0 when hour(ts)<=12 then 1 when hour(ts)<=18 then 2 else 3 end part_bins, (month(ts)%12//3)::int season0,
           case when day(ts)=1 then 1 else 0 end first_day, case when ts::date = last_day(ts) then 1 else 0 end last_day_flag,
           date_diff('day', date '2019-01-01', ts::date)::int whole_days, dayname(ts) day_name, strftime(ts, '%Y-%m-%d') date_text,
           strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' iso_text from events""")
def _(d: Data):
    ts = F.col("ts")
    first, last = cal.month_edges(ts, "exact")
    return d.table("events").select(
        ts, cal.time_of_day(F.hour(ts), "serve").alias("part_serve"), cal.time_of_day(F.hour(ts), "bins").alias("part_bins"), cal.season(F.month(ts), 0).alias("season0"),
        first.alias("first_day"), last.alias("last_day_flag"), cal.days_since_epoch(ts, "whole").alias("whole_days"), cal.day_name(ts).alias("day_name"),
        F.date_format(ts, "yyyy-MM-dd").alias("date_text"), F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("iso_text"))


@query("holidays_of_orders", f"select o_orderkey, o_orderdate::date date, is_holiday, days_to_holiday, days_since_holiday from orders join {NEAR.format('o_orderdate', 'orders')} n on n.date = o_orderdate::date", "holidays")
def _(d: Data):
    o = d.table("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    years = o.agg(F.year(F.min("date")).alias("a"), F.year(F.max("date")).alias("b")).first()
    near = cal.holiday_proximity(o.select("date").distinct(), cal.holiday_table(d.spark, years["a"] - 1, years["b"] + 1))
    return with_weather(o, near, "date")


@query("holiday_trips", "select h.date, count(*) trip_count from trips join holidays h on h.date = started_at::date group by 1", "trips", "holidays")
def _(d: Data):
    daily = d.trips().groupBy(F.col("started_at").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("trip_count"))
    years = daily.agg(F.year(F.min("date")).alias("a"), F.year(F.max("date")).alias("b")).first()
    days = cal.holiday_table(d.spark, years["a"], years["b"])
    return daily.join(days, "date", "left_semi")


# ------------------------------------------------------------------------------------------------------ weather

@query("weather_forward_fill", "select time, round(temp,6) temp, round(prcp,6) prcp, round(wspd,6) wspd from weather_filled", "weather_filled")
def _(d: Data):
    return rounded(series.ffill_bfill(d.weather(), ["temp", "prcp", "wspd"], "time"))


@query("trips_with_weather", "select trip_id, w.time, round(temp,6) temp, round(prcp,6) prcp from trips left join weather w on w.time = date_trunc('hour', started_at)", "trips", "weather")
def _(d: Data):
    t = d.trips().select("trip_id", F.date_trunc("hour", "started_at").cast("timestamp_ntz").alias("time"))
    return rounded(with_weather(t, d.weather().select("time", "temp", "prcp")))


@query("weather_interactions", f"""
    select w.time, round(temp*hour(w.time)/24,6) temp_hour_interaction, round(case when isodow(w.time)>=6 then temp else 0 end,6) temp_weekend_interaction,
      round(case when hour(w.time) in (7,8,9,17,18,19) then temp else 0 end,6) temp_rush_interaction, round(case when isodow(w.time)>=6 then prcp else 0 end,6) rain_weekend,
      round(case when hour(w.time) in (7,8,9,17,18,19) then prcp else 0 end,6) rain_rush_hour, round(temp-0.4*wspd,6) feels_like from weather_filled w""", "weather_filled")
def _(d: Data):
    w = series.ffill_bfill(d.weather(), ["temp", "prcp", "wspd"], "time")
    cols = cal.hour_columns(F.col("time"))
    out = wx.interactions(w.select("*", *[cols[c].alias(c) for c in ("hour", "is_weekend", "is_rush_hour")]))
    return rounded(out.drop("temp", "prcp", "wspd", "hour", "is_weekend", "is_rush_hour"))


@query("weather_extremes", """
    with q as (select quantile_cont(temp,0.9) hot, quantile_cont(temp,0.1) cold, quantile_cont(wspd,0.9) windy from weather_filled)
    select time, (temp>hot)::int is_hot, (temp<cold)::int is_cold, (prcp>1.0)::int is_rainy, (wspd>windy)::int is_windy, (temp<cold or prcp>1.0 or wspd>windy)::int bad_weather
    from weather_filled, q""", "weather_filled")
def _(d: Data):
    w = stage(series.ffill_bfill(d.weather(), ["temp", "prcp", "wspd"], "time"), "weather")
    return wx.extremes(w).drop("temp", "prcp", "wspd")


@query("humidity_estimate", "select date, greatest(30, least(100, 55 + case when prcp>0.01 then 25 else 0 end + date_diff('day', date '1970-01-01', date)%20))::int humidity from day_weather", "day_weather")
def _(d: Data):
    return d.day_weather().select("date", wx.estimate_humidity(F.col("date"), F.when(F.col("prcp") > 0.01, 1.0).otherwise(0.0)).alias("humidity"))


@query("weather_impact", """
    select case when prcp<=0 then 'None' when prcp<=2.5 then 'Light' when prcp<=7.6 then 'Moderate' else 'Heavy' end rain_category, round(avg(pickups),6) pickups
    from hourly h join weather w on w.time=h.time group by 1""", "hourly", "weather")
def _(d: Data):
    w = d.weather().select("time", "prcp")
    sums = rollups.station_hourly(d.trips()).groupBy("time").agg(F.sum("pickups").alias("s"), F.count("pickups").alias("n"))
    return rounded(sums.join(w, "time").groupBy(wx.rain_class(F.col("prcp")).alias("rain_category")).agg((F.sum("s") / F.sum("n")).alias("pickups")))


@query("seasonal_weather", """
    with h as (select distinct date_trunc('hour', ts) time from events), m as (select min(time) lo from h)
    select time, round(15 + 15*sin(2*pi()*(epoch(time-lo)/86400E0)/365) + 5*sin(2*pi()*hour(time)/24E0),6) temp, 0E0 prcp, round(10+5*sin(2*pi()*(epoch(time-lo)/86400E0)/365),6) wspd from h, m""")
def _(d: Data):
    hours = d.table("events").select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).distinct()
    return rounded(wx.seasonal_weather(hours, hours.agg(F.min("time")).scalar(), 5.0))


# ------------------------------------------------------------------------------------------------------ series

LAG_SQL = ", ".join(f"lag(pickups,{k}) over w lag_{k}h" for k in LAGS)
ROLL_SQL = ", ".join(
    f"round(avg(pickups) over (partition by station_name order by time rows between {n} preceding and 1 preceding),6) roll_mean_{n}h, "
    f"round(coalesce(stddev_samp(pickups) over (partition by station_name order by time rows between {n} preceding and 1 preceding),1.0),6) roll_std_{n}h, "
    f"min(pickups) over (partition by station_name order by time rows between {n} preceding and 1 preceding) roll_min_{n}h, "
    f"max(pickups) over (partition by station_name order by time rows between {n} preceding and 1 preceding) roll_max_{n}h" for n in ROLLING)
# closed form: weighted running sum with the weight of the first value not damped by the smoothing factor
EMA_SQL = """round(pow(0.92, i-1) * sum(case when i=1 then x when i>1 then 0.08*x end * pow(0.92, -(i-1))) over (partition by station_name order by time rows unbounded preceding),6)"""
VIEWS["grid_numbered"] = (("grid",), """
    select *, row_number() over (partition by station_name order by time) - 1 i, lag(pickups) over (partition by station_name order by time) x from grid""")
VIEWS["full_spine"] = (("hourly",), "select unnest(range(min(time), max(time) + interval 1 hour, interval 1 hour)) time from hourly")


def grid(d: Data):
    return series.densify(ft.kept_series(d.trips()), ["pickups", "dropoffs", "net_demand"])


@query("hourly_grid", "select station_name, time, pickups::bigint pickups, dropoffs::bigint dropoffs, net_demand::bigint net_demand from grid", "grid")
def _(d: Data):
    return grid(d)


@query("daily_series", "select date, trip_count::bigint trip_count from daily", "daily")
def _(d: Data):
    return series.daily_series(d.order_days())


@query("grid_lags", f"select station_name, time, {LAG_SQL} from grid window w as (partition by station_name order by time)", "grid")
def _(d: Data):
    return series.add_lags(grid(d).select("station_name", "time", "pickups"), "pickups", LAGS).drop("pickups")


@query("sparse_lags_filled", "select station_name, time, " + ", ".join(f"coalesce(lag(pickups,{k}) over (partition by station_name order by time),0) lag_{k}h" for k in LAGS) + " from hourly", "hourly")
def _(d: Data):
    return series.add_lags(rollups.station_hourly(d.trips()).select("station_name", "time", "pickups"), "pickups", LAGS, fill=0).drop("pickups")


@query("grid_rolling", f"select station_name, time, {ROLL_SQL} from grid", "grid")
def _(d: Data):
    return rounded(series.add_rolling(grid(d).select("station_name", "time", "pickups"), "pickups", ROLLING).drop("pickups"))


@query("rolling_of_prices", """
    select o_custkey, o_orderdate, round(avg(v) over w,4) roll_mean_4h, round(stddev_samp(v) over w,4) roll_std_4h, round(min(v) over w,4) roll_min_4h, round(max(v) over w,4) roll_max_4h
    from (select o_custkey, o_orderdate, sum(o_totalprice) v from orders group by 1,2) window w as (partition by o_custkey order by o_orderdate rows between 4 preceding and 1 preceding)""")
def _(d: Data):
    s = d.table("orders").groupBy("o_custkey", "o_orderdate").agg(F.sum("o_totalprice").alias("v"))
    return rounded(series.add_rolling(s, "v", [4], key="o_custkey", time="o_orderdate", std_fill=None, whole_numbers=False).drop("v"), 4)


@query("grid_ema", f"select station_name, time, {EMA_SQL} ema_24h from grid_numbered", "grid_numbered")
def _(d: Data):
    return rounded(series.ema(grid(d).select("station_name", "time", "pickups"), "pickups", EMA_SPAN, "ema_24h").drop("pickups"))


@query("demand_changes", """
    select station_name, time, pickups - lag(pickups) over w demand_change_1h, pickups - lag(pickups,24) over w demand_change_24h
    from grid window w as (partition by station_name order by time)""", "grid")
def _(d: Data):
    s = series.add_lags(grid(d).select("station_name", "time", "pickups"), "pickups", [1, 24])
    return series.add_changes(s).select("station_name", "time", "demand_change_1h", "demand_change_24h")


@query("trend_band", """
    with t as (select date, count(*) over w n, avg(trip_count) over w m, stddev_samp(trip_count) over w s from daily window w as (order by date rows between 6 preceding and current row))
    select date, round(case when n=7 then m else 0 end,6) ma, round(case when n=7 then m+1.96*s else 0 end,6) upper_ci, round(case when n=7 then m-1.96*s else 0 end,6) lower_ci from t""", "daily")
def _(d: Data):
    return rounded(series.trend_band(series.daily_series(d.order_days())))


@query("smoothed_daily", "select date, trip_count::bigint trip_count, cast(floor(avg(trip_count) over (order by date rows between 3 preceding and 3 following) + 0.5) as bigint) trip_count_smooth from daily", "daily")
def _(d: Data):
    return series.smooth(series.daily_series(d.order_days()), 3)


@query("last_week_of_station", "select station_name, time, pickups from hourly qualify row_number() over (partition by station_name order by time desc) <= 168", "hourly")
def _(d: Data):
    return ranking.tail_per_group(rollups.station_hourly(d.trips()).select("station_name", "time", "pickups"), "station_name", "time", 168)


@query("recent_days", "select station_name, time, pickups from hourly where time >= (select max(time) from hourly) - interval 10 day", "hourly")
def _(d: Data):
    return ranking.recent(rollups.station_hourly(d.trips()).select("station_name", "time", "pickups"), "time", 10)


VIEWS["asked"] = ((), "select distinct 'station ' || user_id station_name, date_trunc('hour', max(ts)) at_time from events group by user_id, event_type")
VIEWS["past"] = (("asked", "hourly"), """
    select station_name, at_time, time, pickups, row_number() over (partition by station_name, at_time order by time desc) back from
      (select a.station_name, a.at_time, h.time, h.pickups from asked a join hourly h on h.station_name = a.station_name and h.time < a.at_time) qualify back <= 168""")


def asked(d: Data):
    from dockflow.catalog.base import station_name
    return d.table("events").groupBy("user_id", "event_type").agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("at_time")).select(station_name(F.col("user_id")).alias("station_name"), "at_time").distinct()


@query("history_before", "select station_name, at_time, time, back::int back, pickups from past", "past")
def _(d: Data):
    return series.history_before(rollups.station_hourly(d.trips()).select("station_name", "time", "pickups"), asked(d))


def _serving_sql() -> str:
    parts = [f"coalesce(max(case when back={k} then pickups end),0)::double lag_{k}h" for k in LAGS]
    for n in ROLLING:
        for stat, fn in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")):
            parts.append(f"round(case when count(*)>={n} then {fn}(case when back<={n} then pickups end) else 0 end::double,6) roll_{stat}_{n}h")
    parts.append("round(case when count(*)>=24 then sum(pickups * pow(0.92, back-1) * case when back=m then 1 else 0.08 end) else 0 end,6) ema_24h")
    return "with p as (select *, max(back) over (partition by station_name, at_time) m from past) select station_name, at_time, count(*) n_hist, " + ", ".join(parts) + " from p group by 1,2"


@query("serving_features", _serving_sql(), "past")
def _(d: Data):
    past = series.history_before(rollups.station_hourly(d.trips()).select("station_name", "time", "pickups"), asked(d))
    return rounded(series.serving_features(past, ["station_name", "at_time"]))


@query("latest_weather", """
    select p.station_name, p.at_time, round(coalesce(w.temp,15.0),6) temp, round(coalesce(w.prcp,0.0),6) prcp, round(coalesce(w.wspd,5.0),6) wspd from past p left join weather w on w.time = p.time where back = 1""", "past", "weather")
def _(d: Data):
    hist = with_weather(rollups.station_hourly(d.trips()).select("station_name", "time", "pickups"), d.weather())
    return rounded(series.latest_weather(series.history_before(hist, asked(d)), ["station_name", "at_time"], wx.WEATHER_DEFAULTS))


@query("value_sequences", """
    select station_name, time, pickups, list_sum(seq)::bigint seq_sum, seq[1] oldest, seq[24] newest from (
      select station_name, time, pickups, list(pickups) over (partition by station_name order by time rows between 24 preceding and 1 preceding) seq from grid) where len(seq)=24""", "grid")
def _(d: Data):
    s = series.sequences(grid(d), "pickups", 24)
    return s.select("station_name", "time", "pickups", F.aggregate("seq", F.lit(0).cast("long"), lambda a, v: a + v).alias("seq_sum"),
                    F.element_at("seq", 1).alias("oldest"), F.element_at("seq", -1).alias("newest"))


# ------------------------------------------------------------------------------------------------------ feature table

_other = [c for c in FEATURES if c.startswith(("lag_", "roll_", "ema"))]
FEATURE_SQL = f"""
    with hist as (select station_name, time, pickups, dropoffs, net_demand, {LAG_SQL}, {ROLL_SQL}, {EMA_SQL} ema_24h from grid_numbered window w as (partition by station_name order by time)),
    hours as (select s.time, round(temp,6) temp, round(prcp,6) prcp, round(wspd,6) wspd, {calendar_sql('s.time')}, is_holiday, days_to_holiday, days_since_holiday
              from hour_weather s join {NEAR.format('time', 'spine')} n on n.date = s.time::date)
    select hist.*, hours.* exclude (time) from hist join hours on hours.time = hist.time"""


@query("feature_table", FEATURE_SQL, "grid_numbered", "hour_weather", "holidays")
def _(d: Data):
    return rounded(ft.feature_table(d.trips(), d.weather()))


@query("weather_features_of_grid", f"""
    with q as (select quantile_cont(temp,0.9) hot, quantile_cont(temp,0.1) cold, quantile_cont(wspd,0.9) windy from grid join hour_weather using (time))
    select time, (temp>hot)::int is_hot, (temp<cold)::int is_cold, (prcp>1.0)::int is_rainy, (wspd>windy)::int is_windy, (temp<cold or prcp>1.0 or wspd>windy)::int bad_weather,
      round(temp-0.4*wspd,6) feels_like from hour_weather, q""", "grid", "hour_weather")
def _(d: Data):
    out = ft.hour_features(ft.kept_series(d.trips()), d.weather(), with_extremes=True)
    return rounded(out.select("time", "is_hot", "is_cold", "is_rainy", "is_windy", "bad_weather", "feels_like"))


@query("evaluation_features", f"""
    with n as (select *, row_number() over (partition by station_name order by time)-1 i, lag(pickups) over (partition by station_name order by time) x from hourly)
    select station_name, time, pickups, coalesce(lag(pickups,24) over (partition by station_name order by time),0) lag_24h, round(coalesce({EMA_SQL.replace('round(','(',1).replace(',6)',')')},0),6) ema_24h,
      round(coalesce(stddev_samp(pickups) over (partition by station_name order by time rows between 12 preceding and 1 preceding),1.0),6) roll_std_12h,
      round(coalesce(avg(pickups) over (partition by station_name order by time rows between 168 preceding and 1 preceding),0),6) roll_mean_168h from n""", "hourly")
def _(d: Data):
    return rounded(ft.evaluation_features(d.trips(), d.weather()).select("station_name", "time", "pickups", "lag_24h", "ema_24h", "roll_std_12h", "roll_mean_168h"))


# ------------------------------------------------------------------------------------------------------ preparation

@query("standard_scaled", """
    with m as (select avg(o_totalprice) a, stddev_pop(o_totalprice) s, avg(o_custkey) b, stddev_pop(o_custkey) t from orders)
    select o_orderkey, round((o_totalprice-a)/s,6) o_totalprice, round((o_custkey-b)/t,6) o_custkey from orders, m""")
def _(d: Data):
    o = d.table("orders").select("o_orderkey", "o_totalprice", "o_custkey")
    cols = ["o_totalprice", "o_custkey"]
    return rounded(preparation.apply_standard(o, cols, preparation.fit_standard(o, cols)))


@query("scaled_back", "select o_orderkey, round(greatest(0, o_totalprice-1000),4) v from orders")
def _(d: Data):
    o = d.table("orders").select("o_orderkey", (F.col("o_totalprice") - 1000).alias("v"))
    fit = preparation.fit_standard(o, ["v"])
    return rounded(preparation.apply_standard(o, ["v"], fit).select("o_orderkey", preparation.invert_standard(F.col("v"), fit, "v").alias("v")), 4)


@query("merged_chunk_scaler", "select o_orderpriority, count(*)::bigint n, round(avg(o_totalprice),4) mean, round(stddev_pop(o_totalprice),4) std from orders group by 1")
def _(d: Data):
    chunks = d.table("orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean"), (F.var_pop("o_totalprice") * F.count(F.lit(1))).alias("m2"))
    return rounded(preparation.merge_standard(chunks, ["o_orderpriority"]), 4)


@query("minmax_scaled", """
    with m as (select min(o_totalprice) lo, max(o_totalprice) hi from orders) select o_orderkey, round((o_totalprice-lo)/(hi-lo),6) unit, round(2*(o_totalprice-lo)/(hi-lo)-1,6) signed from orders, m""")
def _(d: Data):
    o = d.table("orders").select("o_orderkey", "o_totalprice")
    out = preparation.scale_minmax(preparation.scale_minmax(o, "o_totalprice", out="unit"), "o_totalprice", -1.0, 1.0, out="signed")
    return rounded(out.drop("o_totalprice"))


@query("robust_scaled", """
    with m as (select quantile_cont(o_totalprice,0.25) a, quantile_cont(o_totalprice,0.5) b, quantile_cont(o_totalprice,0.75) c from orders) select o_orderkey, round((o_totalprice-b)/(c-a),6) v from orders, m""")
def _(d: Data):
    o = d.table("orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return rounded(preparation.scale_robust(o, "v"))


@query("time_split", """
    select station_name, time, case when row_number() over (order by time, station_name) <= cast(floor(0.8*count(*) over ()) as bigint) then 1 else 0 end is_train from hourly""", "hourly")
def _(d: Data):
    return preparation.time_split(rollups.station_hourly(d.trips()).select("station_name", "time"))


@query("time_folds", """
    select station_name, time, greatest(0, 3 - (n - rn)//(n//4))::int fold from (select station_name, time, row_number() over (order by time, station_name) rn, count(*) over () n from hourly)""", "hourly")
def _(d: Data):
    return preparation.time_folds(rollups.station_hourly(d.trips()).select("station_name", "time"), 3)


@query("median_filled_lags", """
    with l as (select station_name, time, lag(pickups,24) over (partition by station_name order by time)::double lag_24h from grid)
    select station_name, time, coalesce(lag_24h, (select quantile_cont(lag_24h,0.5) from l)) lag_24h from l""", "grid")
def _(d: Data):
    s = series.add_lags(grid(d).select("station_name", "time", "pickups"), "pickups", [24]).select("station_name", "time", F.col("lag_24h").cast("double").alias("lag_24h"))
    return quantiles.fill_median(s, ["lag_24h"])


@query("training_rows", "select station_name, time, pickups::bigint pickups from (select *, lag(pickups,168) over (partition by station_name order by time) l from grid) where l is not null", "grid")
def _(d: Data):
    return ft.training_rows(series.add_rolling(series.add_lags(grid(d).select("station_name", "time", "pickups"), "pickups", [24, 168]), "pickups", [24])).select("station_name", "time", "pickups")
