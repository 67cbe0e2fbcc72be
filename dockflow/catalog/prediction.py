"""Queries on forecasts, their evaluation and models."""

from pyspark.sql import functions as F

from dockflow.catalog.base import Data, VIEWS, query, rounded, station_name
from dockflow.catalog.timeline import FEATURE_SQL, grid
from dockflow.operators import evaluation, forecasting, models, preparation, rollups
from dockflow.operators.joins import pred_vs_actual
from dockflow.plans import feature_table as ft
from dockflow.plans import forecast as fc
from dockflow.plans import training
from dockflow.plans.publish import HISTORY_COLUMNS, RECENT_COLUMNS, RECENT_DAYS, publish, published_sizes
from dockflow.schemas import FEATURES
from dockflow.session import stage, stage_path
from dockflow.sources.sinks import open_buckets

VIEWS["requests"] = ((), """
    select 'station ' || user_id station_name, date_trunc('hour', max(ts)) start, date_trunc('hour', max(ts)) + to_hours(cast(user_id % 60 - 2 as int)) + interval 30 minute as stop from events group by user_id""")
VIEWS["horizon"] = (("requests",), """
    select station_name, start, unnest(range(0, greatest(1, least(168, cast(floor(epoch(stop - start)/3600) as bigint))))) step from requests""")
VIEWS["means"] = (("hourly",), """
    select h.station_name, h.hh, d.dd, hm, dm, om from (select station_name, hour(time) hh, avg(pickups) hm from hourly where pickups > 0 group by 1,2) h
    join (select station_name, isodow(time)-1 dd, avg(pickups) dm from hourly where pickups > 0 group by 1,2) d on d.station_name = h.station_name
    join (select station_name, avg(pickups) om from hourly where pickups > 0 group by 1) o on o.station_name = h.station_name""")
VIEWS["forecasts"] = (("horizon", "hourly"), """
    with f as (select station_name, start, step, start + to_hours(cast(step as int)) time from horizon), k as (select * from hourly)
    select f.station_name, f.time, f.step::int step, case when om is null then
        (case when hour(f.time) in (7,8,9,17,18,19) then 25.0 when hour(f.time) between 10 and 16 then 18.0 when hour(f.time) between 20 and 22 then 15.0 else 12.0 end) * case when isodow(f.time)>=6 then 0.7 else 1.0 end
        else greatest(0, 0.6*coalesce(hm,om) + 0.3*coalesce(dm,om) + 0.1*om) end::double predicted
    from f left join (select station_name, hour(time) hh, avg(pickups) hm from k group by 1,2) a on a.station_name=f.station_name and a.hh=hour(f.time)
      left join (select station_name, isodow(time) dd, avg(pickups) dm from k group by 1,2) b on b.station_name=f.station_name and b.dd=isodow(f.time)
      left join (select station_name, avg(pickups) om from k group by 1) c on c.station_name=f.station_name""")
VIEWS["model_votes"] = (("backcast",), """
    select station_name, time, actual, 'means' as model, predicted from backcast union all select station_name, time, actual, 'overall', avg(actual) over (partition by station_name) from backcast
    union all select station_name, time, actual, 'constant', 1E0 from backcast""")


def requests(d: Data):
    """A forecast per station from its last hour on, -2 to 57 hours long (short ones become one hour)."""
    start = F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz")
    e = d.table("events").groupBy("user_id").agg(start.alias("start"))
    hours = F.make_dt_interval(F.lit(0), (F.col("user_id") % 60 - 2).cast("int"), F.lit(30))
    return e.select(station_name(F.col("user_id")).alias("station_name"), "start", (F.col("start") + hours).alias("end"))


def known_history(d: Data):
    """History of all stations."""
    return rollups.station_hourly(d.trips())


def backcast(d: Data):
    """Every station hour with its actual pickups and the forecast of the station's own means."""
    h = stage(rollups.station_hourly(d.trips()), "station-hourly")
    joined = h.join(forecasting.station_means(h), "station_name")
    return joined.select("station_name", "time", F.col("pickups").alias("actual"), forecasting.blend_means(F.hour("time"), F.weekday("time")).alias("predicted"))


def votes(d: Data):
    from pyspark.sql import Window
    b = backcast(d)
    overall = F.avg("actual").over(Window.partitionBy("station_name"))
    as_model = lambda name, c: F.struct(F.lit(name).alias("model"), c.alias("predicted"))
    three = F.array(as_model("means", F.col("predicted")), as_model("overall", F.col("overall")), as_model("constant", F.lit(1.0)))
    return b.withColumn("overall", overall).select("station_name", "time", "actual", F.explode(three).alias("m")).select("station_name", "time", "actual", "m.*")


@query("forecast_horizon", "select station_name, start + to_hours(cast(step as int)) time, step::int step from horizon", "horizon")
def _(d: Data):
    return forecasting.horizon(requests(d)).select("station_name", "time", "step")


@query("forecast_horizon_limits", """
    with r as (select station_name, start, cast(floor(epoch(stop - start)/3600) as bigint) asked from requests)
    select station_name, start + to_hours(cast(step as int)) time, step::int step, cut, "limit" from (
      select station_name, start, unnest(range(0, greatest(1, least(24, asked)))) step, asked > 24 cut, 24 "limit" from r
      union all select station_name, start, unnest(range(0, greatest(1, asked))), false, null from r)""", "requests")
def _(d: Data):
    """The horizon cut at a day, with the cut shown, and without any limit."""
    parts = [forecasting.horizon(requests(d), most=n, mark="cut").select("station_name", "time", "step", "cut", F.lit(n).cast("int").alias("limit")) for n in (24, None)]
    return parts[0].unionByName(parts[1])


@query("statistical_forecast", "select station_name, time, step, round(predicted,9) predicted from forecasts", "forecasts")
def _(d: Data):
    return rounded(fc.forecast(requests(d), known_history(d))["predictions"], 9)


@query("forecast_kpis", """
    select station_name, floor(sum(predicted))::bigint total, strftime(arg_min(time, (-predicted, time)), '%H:%M') peak_time, round(max(predicted),6) peak, round(avg(predicted),6) mean from forecasts group by 1""", "forecasts")
def _(d: Data):
    return rounded(fc.forecast(requests(d), known_history(d))["kpis"])


@query("rule_forecast", """
    select event_id, (case when hour(ts) in (7,8,9,17,18,19) then 25.0 when hour(ts) between 10 and 16 then 18.0 when hour(ts) between 20 and 22 then 15.0 else 12.0 end * case when isodow(ts)>=6 then 0.7 else 1.0 end)::double predicted from events""")
def _(d: Data):
    return rounded(d.table("events").select("event_id", forecasting.rule_forecast(F.col("ts")).alias("predicted")))


@query("backcast", "select station_name, time, actual, round(predicted,9) predicted from backcast", "backcast")
def _(d: Data):
    return rounded(backcast(d), 9)


@query("calibrated_forecast", """
    with h as (select station_name, count(*) n, avg(pickups) m, stddev_pop(pickups) s from hourly group by 1), p as (select station_name, avg(predicted) m, stddev_pop(predicted) s from backcast group by 1)
    select b.station_name, b.time, round(case when h.n > 10 and h.s > 0 then greatest(0, h.m + (predicted-p.m)*least(5, greatest(1, h.s/case when p.s>0 then p.s else 1 end))) else predicted end,9) predicted
    from backcast b join p on p.station_name=b.station_name left join h on h.station_name=b.station_name""", "backcast", "hourly")
def _(d: Data):
    b = backcast(d)
    return rounded(forecasting.calibrate(b.select("station_name", "time", "predicted"), b.withColumnRenamed("actual", "pickups")), 9)


@query("blended_forecast", """
    with m as (select station_name, hour(time) h, avg(pickups) m from hourly group by 1,2)
    select b.station_name, time, round(case when m is null then predicted else 0.7*predicted + 0.3*m end,9) predicted from backcast b left join m on m.station_name=b.station_name and h=hour(time)""", "backcast", "hourly")
def _(d: Data):
    b = backcast(d)
    return rounded(forecasting.blend_hourly(b.select("station_name", "time", "predicted"), b.withColumnRenamed("actual", "pickups")), 9)


@query("ensemble_forecast", """
    with w as (select model, (1/mae)/sum(1/mae) over () weight from (select model, avg(abs(actual-predicted)) mae from model_votes where model <> 'constant' group by 1))
    select station_name, time, round(sum(coalesce(weight,1/3E0)*predicted)/sum(coalesce(weight,1/3E0)),6) predicted from model_votes v left join w on w.model=v.model group by 1,2""", "model_votes")
def _(d: Data):
    v = stage(votes(d), "votes")
    w = forecasting.inverse_mae_weights(evaluation.metrics(v.where("model <> 'constant'"), ["model"]))
    return rounded(forecasting.ensemble(v, w, ["station_name", "time"]))


@query("model_weights", "select model, round(mae,6) mae, round((1/mae)/sum(1/mae) over (),6) weight from (select model, avg(abs(actual-predicted)) mae from model_votes group by 1)", "model_votes")
def _(d: Data):
    return rounded(forecasting.inverse_mae_weights(evaluation.metrics(votes(d), ["model"])))


@query("forecast_vs_actual", """
    select f.station_name, f.time, round(predicted,9) predicted, h.pickups actual from forecasts f left join hourly h on h.station_name=f.station_name and h.time=f.time""", "forecasts", "hourly")
def _(d: Data):
    pred = forecasting.statistical_forecast(requests(d), known_history(d)).select("station_name", "time", "predicted")
    actual = rollups.station_hourly(d.trips()).select("station_name", "time", F.col("pickups").alias("actual"))
    return rounded(pred_vs_actual(pred, actual, ["station_name"]), 9)


METRICS = """count(*) n, round(avg(abs(actual-predicted)),6) mae, round(sqrt(avg(pow(actual-predicted,2))),6) rmse, round(1-sum(pow(actual-predicted,2))/nullif(var_pop(actual)*count(*),0),6) r2,
    round(avg(case when actual>0 then abs((actual-predicted)/actual) end)*100,6) mape"""


@query("forecast_metrics", f"select {METRICS} from backcast", "backcast")
def _(d: Data):
    return rounded(evaluation.metrics(backcast(d)))


@query("forecast_metrics_by_station", f"select station_name, {METRICS} from backcast group by 1", "backcast")
def _(d: Data):
    return rounded(evaluation.metrics(backcast(d), ["station_name"]))


@query("shown_accuracy", """
    with r as (select actual, case when predicted < actual then ceil(predicted) else floor(predicted) end predicted from backcast)
    select round(avg(abs(predicted-actual)),6) mae, round(sum(case when actual<>0 then abs((predicted-actual)/actual) else 0 end)/count(*)*100,6) mape, count(*) samples, floor(sum(actual)+0.5)::bigint total_actual from r""", "backcast")
def _(d: Data):
    return rounded(evaluation.shown_accuracy(backcast(d)))


@query("rounded_forecast", """
    select f.station_name, f.time, case when h.pickups is null then floor(predicted+0.5) when predicted < h.pickups then ceil(predicted) else floor(predicted) end::bigint predicted
    from forecasts f left join hourly h on h.station_name=f.station_name and h.time=f.time""", "forecasts", "hourly")
def _(d: Data):
    pred = forecasting.statistical_forecast(requests(d), known_history(d)).select("station_name", "time", "predicted")
    actual = rollups.station_hourly(d.trips()).select("station_name", "time", F.col("pickups").alias("actual"))
    return evaluation.round_towards(pred_vs_actual(pred, actual, ["station_name"])).drop("actual")


@query("sliced_errors", """
    select case when hour(time)<=6 then 'night' when hour(time)<=9 then 'morning_rush' when hour(time)<=16 then 'midday' when hour(time)<=19 then 'evening_rush' else 'evening' end slice,
      count(*) n, round(avg(abs(actual-predicted)),6) mae, round(1-sum(pow(actual-predicted,2))/(var_pop(actual)*count(*)),6) r2 from backcast group by 1
    union all select case when isodow(time)>=6 then 'weekend' else 'weekday' end, count(*), round(avg(abs(actual-predicted)),6), round(1-sum(pow(actual-predicted,2))/(var_pop(actual)*count(*)),6) from backcast group by 1""", "backcast")
def _(d: Data):
    return rounded(evaluation.sliced_errors(backcast(d)))


@query("error_distribution", """
    select round(avg(predicted-actual),6) mean_error, round(stddev_samp(predicted-actual),6) std_error, round(avg(case when abs(predicted-actual)<=7 then 1.0 else 0 end),6) share_within,
      round(corr(predicted,actual),6) correlation, round(regr_slope(predicted,actual),6) slope, round(regr_intercept(predicted,actual),6) intercept from backcast""", "backcast")
def _(d: Data):
    return rounded(evaluation.error_distribution(backcast(d)))


@query("system_forecast_profile", """
    select time, null::date date, round(avg(actual),6) actual, round(avg(predicted),6) predicted from backcast group by 1
    union all select null, time::date d, round(sum(actual),6), round(sum(predicted),6) from backcast group by 2""", "backcast")
def _(d: Data):
    return rounded(evaluation.system_profile(backcast(d)))


@query("model_comparison", f"""
    with m as (select model, {METRICS}, avg(abs(actual-predicted)) e from model_votes group by 1)
    select * exclude (e), round((e - (select e from m where model='constant'))/(select e from m where model='constant')*100,6) mae_delta_pct from m""", "model_votes")
def _(d: Data):
    return rounded(evaluation.compare_models(votes(d), "constant"))


# ------------------------------------------------------------------------------------------------------ models

# Sizes of a trial of the whole job; those of the full one are the defaults of ``Sizes``.
TRIAL = training.Sizes(boosted={"boosted_deep": {"maxDepth": 4, "stepSize": 0.3}, "boosted_even": {"maxDepth": 3, "stepSize": 0.3}, "boosted_slow": {"maxDepth": 3, "stepSize": 0.2}},
                       rounds=5, forest={"numTrees": 8, "maxDepth": 6}, isolation_trees=50, votes=4)  # most hours have no trip: two rules alone would call every trip an outlier
_trained: dict[tuple[str, str], str] = {}


def trained(d: Data) -> str:
    """Where the job saved its artefacts for these tables; it runs once a session."""
    at = (d.spark.sparkContext.applicationId, d.folder)
    if at not in _trained:
        root = stage_path(d.spark, "trained")
        training.train(ft.feature_table(d.trips(), d.weather()), root, TRIAL)
        _trained[at] = root
    return _trained[at]


@query("tree_model_metrics")
def _(d: Data):
    """Three boosted sets, a forest and their ensemble on the last fifth in time, as saved by the training job."""
    return d.spark.read.parquet(f"{trained(d)}/metrics")


@query("tree_feature_importance")
def _(d: Data):
    """All features by their importance in the saved forest."""
    return models.importances(d.table("events"), training.load(d.spark, trained(d)).models["forest"], FEATURES)


@query("parameter_search")
def _(d: Data):
    rows = models.assemble(ft.training_rows(ft.feature_table(d.trips(), d.weather())), FEATURES)
    rows = stage(rows.select("station_name", "time", F.col("pickups").cast("double").alias("pickups"), "features"), "search-rows")
    folds = preparation.time_folds(rows, 3)
    candidates = models.grid(maxDepth=[2, 3, 4, 5], numTrees=[3, 6])
    return models.halving(folds, lambda **p: models.forest(FEATURES, **p), candidates, ["station_name", "time"], folds=3)


@query("model_forecast")
def _(d: Data):
    """Ensemble forecast for every station from its last hour on, by the saved models, calibrated and blended."""
    saved = training.load(d.spark, trained(d))
    history = stage(grid(d).join(stage(d.weather(), "forecast-weather"), "time", "left"), "history")
    return fc.forecast_models(requests(d), history, saved.models, saved.weights, saved.scaler_x, saved.scaler_y)


@query("model_forecast_keys", """select station_name, start at_time, start + to_hours(cast(step as int)) time, step::int step from horizon""", "horizon")
def _(d: Data):
    """Which hours are forecast: every one of every request, once, whatever the models say."""
    saved = training.load(d.spark, trained(d))
    history = stage(grid(d).join(stage(d.weather(), "forecast-weather"), "time", "left"), "history")
    return fc.forecast_models(requests(d), history, saved.models, saved.weights, saved.scaler_x, saved.scaler_y).where("predicted >= 0").select("station_name", "at_time", "time", "step")


_published: dict[tuple[str, str], dict[str, str]] = {}


def published(d: Data) -> dict[str, str]:
    """Places of the published tables; they are written once a session."""
    at = (d.spark.sparkContext.applicationId, d.folder)
    if at not in _published:
        series = ft.kept_series(d.trips())
        features = ft.feature_table(d.trips(), d.weather(), series=series)
        _published[at] = publish(features, rollups.station_quality(series), evaluation.metrics(backcast(d)), stage_path(d.spark, "published"))
    return _published[at]


VIEWS["features"] = (("grid_numbered", "hour_weather", "holidays"), FEATURE_SQL)


@query("published_tables", f"""
    select * from (values ('history', (select count(*) from features)), ('recent', (select count(*) from features where time >= (select max(time) from features) - interval {RECENT_DAYS} day)),
      ('station_metadata', (select count(distinct station_name) from features)), ('top_stations', (select count(*) from quality)), ('model_summary', 1)) t(name, n_rows)""", "features", "quality")
def _(d: Data):
    return published_sizes(d.spark, published(d))


@query("published_history", f"select {', '.join(HISTORY_COLUMNS)} from features", "features")
def _(d: Data):
    return rounded(open_buckets(d.spark, published(d)["history"]))


@query("published_recent", f"select {', '.join(RECENT_COLUMNS)} from features where time >= (select max(time) from features) - interval {RECENT_DAYS} day", "features")
def _(d: Data):
    return rounded(d.spark.read.parquet(published(d)["recent"]))


@query("published_metadata", "select station_name, round(avg(pickups),6) mean_demand, round(coalesce(stddev_samp(pickups),1.0),6) std_demand, max(pickups) max_demand from grid group by 1", "grid")
def _(d: Data):
    return rounded(d.spark.read.parquet(published(d)["station_metadata"]))


@query("published_stations", "select station_name, round(score,6) score from quality", "quality")
def _(d: Data):
    return rounded(d.spark.read.parquet(published(d)["top_stations"]))


@query("published_summary", f"select {METRICS} from backcast", "backcast")
def _(d: Data):
    return rounded(d.spark.read.json(published(d)["model_summary"]))
