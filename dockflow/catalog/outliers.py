"""Queries on outliers, spectra and denoising."""

from pyspark.sql import functions as F

from dockflow.catalog.base import Data, VIEWS, query, rounded
from dockflow.catalog.timeline import grid
from dockflow.operators import anomalies, quantiles, rollups, series
from dockflow.plans import feature_table as ft
from dockflow.session import stage

VIEWS["prices"] = ((), "select o_orderkey, o_totalprice * case when o_orderkey % 97 = 0 then 9 else 1 end v from orders")
VIEWS["flags"] = (("prices",), """
    with q as (select quantile_cont(v,0.25) q1, quantile_cont(v,0.75) q3, quantile_cont(v,0.5) m, avg(v) a, stddev_pop(v) s, quantile_cont(v,0.01) lo, quantile_cont(v,0.99) hi from prices),
    d as (select quantile_cont(abs(v-m),0.5) mad from prices, q)
    select o_orderkey, v, lo, hi, (v < q1-4*(q3-q1) or v > q3+4*(q3-q1))::int iqr_outlier, (abs((v-a)/s) > 4)::int z_outlier, (abs(v-m) > 6*1.4826*mad)::int mad_outlier from prices, q, d""")
VIEWS["outliers"] = (("flags",), "select *, (iqr_outlier + z_outlier + mad_outlier >= 2)::int is_outlier from flags")


def prices(d: Data):
    return d.table("orders").select("o_orderkey", (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 97 == 0, 9).otherwise(1)).alias("v"))


def flagged(d: Data):
    out = anomalies.rule_flags(prices(d), "v")
    return anomalies.consensus(out, ["iqr_outlier", "z_outlier", "mad_outlier"])


@query("outlier_flags", "select o_orderkey, iqr_outlier, z_outlier, mad_outlier, is_outlier from outliers", "outliers")
def _(d: Data):
    return flagged(d).drop("v")


@query("outliers_removed", "select o_orderkey, round(v,4) v from outliers where is_outlier = 0", "outliers")
def _(d: Data):
    return rounded(anomalies.remove_outliers(flagged(d)).select("o_orderkey", "v"), 4)


@query("outliers_capped", "select o_orderkey, round(case when is_outlier=1 then greatest(lo, least(hi, v)) else v end,4) v from outliers", "outliers")
def _(d: Data):
    return rounded(anomalies.cap_outliers(flagged(d), "v", source=prices(d)).select("o_orderkey", "v"), 4)


@query("outlier_box_stats", """
    select is_outlier, round(min(v),4) "min", round(quantile_cont(v,0.25),4) q25, round(quantile_cont(v,0.5),4) q50, round(quantile_cont(v,0.75),4) q75, round(max(v),4) "max" from outliers group by 1""", "outliers")
def _(d: Data):
    return rounded(quantiles.box_stats(stage(flagged(d), "flagged"), "v", "is_outlier", [0, 1]), 4)


@query("net_demand_outliers", """
    with h as materialized (select station_name, time, abs(net_demand) n from hourly),
    q as materialized (select quantile_cont(n,0.25) q1, quantile_cont(n,0.75) q3, avg(n) a, stddev_pop(n) s from h)
    select station_name, time, (n < q1-4*(q3-q1) or n > q3+4*(q3-q1))::int iqr_outlier, (abs((n-a)/s) > 4)::int z_outlier from h, q""", "hourly")
def _(d: Data):
    s = stage(rollups.station_hourly(d.trips()), "station-hourly").select("station_name", "time", F.abs("net_demand").cast("double").alias("n"))
    return anomalies.rule_flags(s, "n", mad=None).drop("n")


@query("isolation_forest")
def _(d: Data):
    x = series.add_rolling(series.add_lags(grid(d).select("station_name", "time", "pickups"), "pickups", [24]), "pickups", [24])
    return anomalies.isolation_forest(x, ["station_name", "time"], ["pickups", "lag_24h", "roll_mean_24h"])


@query("local_outlier_factor", """
    with h as (select station_name, hourly.time, pickups::double a, dropoffs::double b, temp c, prcp d, wspd e from hourly left join weather on weather.time = hourly.time),
    sh as (select * from h where substr(md5('42|' || station_name || '|' || time::varchar), 1, 8) < '0ccccccd'),
    s as (select row_number() over () id, station_name, time, a, b, coalesce(c, (select quantile_cont(c,0.5) from sh)) c, coalesce(d, (select quantile_cont(d,0.5) from sh)) d, coalesce(e, (select quantile_cont(e,0.5) from sh)) e from sh),
    pairs as (select x.id x, y.id y, sqrt((x.a-y.a)*(x.a-y.a) + (x.b-y.b)*(x.b-y.b) + (x.c-y.c)*(x.c-y.c) + (x.d-y.d)*(x.d-y.d) + (x.e-y.e)*(x.e-y.e)) dist from s x join s y on x.id <> y.id),
    reach as (select x, max(dist) kd from (select x, dist, row_number() over (partition by x order by dist) rn from pairs) where rn <= 20 group by 1),
    near as (select pairs.* from pairs join reach on reach.x = pairs.x where dist <= kd),
    dense as (select near.x, 1/(avg(greatest(dist, kd)) + 1E-10) density from near join reach on reach.x = y group by 1),
    score as (select near.x, round(avg(o.density)/any_value(own.density), 9) lof from near join dense o on o.x = near.y join dense own on own.x = near.x group by 1),
    edge as (select quantile_cont(lof, 0.95) edge from score)
    select h.station_name, h.time, round(lof, 6) lof, (coalesce(lof, 0) > edge)::int lof_outlier from h left join s on s.station_name = h.station_name and s.time = h.time left join score on x = id, edge""", "hourly", "weather")
def _(d: Data):
    s = stage(rollups.station_hourly(d.trips()).join(d.weather(), "time", "left"), "lof-hours")
    return rounded(anomalies.local_outlier_factor(s, ["station_name", "time"], ["pickups", "dropoffs", "temp", "prcp", "wspd"], k=20, share=0.05), 6)


VOTED = ["pickups", "temp", "prcp", "roll_mean_24h", "lag_24h"]


@query("outlier_votes")
def _(d: Data):
    """Four methods on five columns of the complete grid: two rules, the forest, and the factors, all on every row."""
    rows = ft.feature_table(d.trips(), d.weather()).select("station_name", "time", *VOTED)
    return anomalies.four_votes(stage(rows, "voted"), "pickups", ["station_name", "time"], VOTED).drop(*VOTED[1:])


PERIODS = [24.0, 12.0, 8.0, 6.0, 168.0, 84.0]


@query("periodogram", """
    with s as (select station_name, pickups x, date_diff('hour', (select min(time) from hourly), time) t from hourly), p(period) as (values (24E0),(12E0),(8E0),(6E0),(168E0),(84E0))
    select station_name, period, round(pow(sum(x*cos(2*pi()*t/period)),2) + pow(sum(x*sin(2*pi()*t/period)),2),4) power from s, p group by 1,2""", "hourly")
def _(d: Data):
    return rounded(anomalies.periodogram(rollups.station_hourly(d.trips()), PERIODS), 4)


@query("dominant_frequencies", """
    with n as (select min(time) lo, date_diff('hour', min(time), max(time)) + 1 n from hourly), s as (select station_name, pickups x, date_diff('hour', lo, time) t, n from hourly, n where pickups <> 0),
    k as (select unnest(range(1, n//2 + 1)) k from n), p as (select station_name, k, n, pow(sum(x*cos(2*pi()*((k*t)%n)/n)),2) + pow(sum(x*sin(2*pi()*((k*t)%n)/n)),2) power from s, k group by 1,2,3)
    select station_name, row_number() over (partition by station_name order by round(power,6) desc, k)::int "rank", round(k/n,6) freq, round(power,4) power from p qualify "rank" <= 3""", "hourly")
def _(d: Data):
    return rounded(anomalies.dominant_periods(rollups.station_hourly(d.trips())).withColumn("power", F.round("power", 4)))


@query("denoised_pickups", """
    with a0 as (select station_name, time, pickups::double a0, row_number() over w rn, count(*) over (partition by station_name) n, first_value(pickups::double) over w f0 from grid window w as (partition by station_name order by time)),
    a1 as (select *, (a0 + coalesce(lag(a0,1) over w, f0))/2 a1 from a0 window w as (partition by station_name order by time)),
    a2 as (select *, (a1 + coalesce(lag(a1,2) over w, first_value(a1) over w))/2 a2 from a1 window w as (partition by station_name order by time)),
    a3 as (select *, (a2 + coalesce(lag(a2,4) over w, first_value(a2) over w))/2 a3 from a2 window w as (partition by station_name order by time)),
    m as (select station_name, quantile_cont(abs(a0-a1),0.5)/0.6745 sigma from a3 group by 1)
    select a3.station_name, time, round(a3 + sign(a2-a3)*greatest(abs(a2-a3)-t,0) + sign(a1-a2)*greatest(abs(a1-a2)-t,0) + sign(a0-a1)*greatest(abs(a0-a1)-t,0),6) pickups_denoised
    from (select a3.*, sigma*sqrt(2*ln(n)) t from a3 join m on m.station_name = a3.station_name) a3""", "grid")
def _(d: Data):
    return rounded(anomalies.denoise(grid(d).select("station_name", "time", "pickups"), "pickups").drop("pickups"))
