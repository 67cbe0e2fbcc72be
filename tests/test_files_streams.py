"""Sources, sinks and streams on small files."""

import datetime as dt
import json

from pyspark.sql import functions as F

from dockflow import schemas
from dockflow.functions.cleaning import align_features, missing_features
from dockflow.session import stage, stage_path, staging
from dockflow.sources import files, sinks
from dockflow.streaming import live

ORDER = ["last_reported"]


def test_first_existing_and_absent(spark, tmp_path):
    assert files.read_csv(spark, [str(tmp_path / "no"), str(tmp_path / "none")], schemas.TRIPS) is None
    assert files.read_json_asset(spark, str(tmp_path / "no.json")) is None
    p = tmp_path / "t.csv"
    p.write_text("trip_id,started_at\n1,2024-01-01 00:00:05\nbad,not a time\n")
    schema = schemas.T.StructType([schemas.TRIPS["trip_id"], schemas.TRIPS["started_at"]])
    rows = files.read_csv(spark, [str(tmp_path / "no"), str(p)], schema).collect()
    assert rows[0].trip_id == 1 and rows[0].started_at == dt.datetime(2024, 1, 1, 0, 0, 5) and rows[1].trip_id is None


def test_trip_globs_match_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("trip_id,member_casual\n1,member\n")
    (tmp_path / "b1.csv").write_text("member_casual,extra,trip_id\ncasual,z,2\n")
    out = files.read_trip_files(spark, [str(tmp_path / "a*.csv"), str(tmp_path / "b*.csv"), str(tmp_path / "c*.csv")], schemas.TRIPS)
    assert sorted((r.trip_id, r.member_casual, r.start_lat) for r in out.collect()) == [(1, "member", None), (2, "casual", None)]
    assert out.columns == schemas.TRIPS.names
    assert files.read_trip_files(spark, [str(tmp_path / "c*.csv")], schemas.TRIPS).count() == 0


def test_json_array_asset_and_dictionary_form(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"lat": 1.0, "weight": 2}, {"lat": 3.0, "weight": 4}]))
    df = files.read_json_asset(spark, str(tmp_path / "a.json"))
    assert df.count() == 2
    assert sorted(r.record for r in sinks.keyed_records(df.select("weight", "lat"), "weight").collect()) == ['{"2":{"lat":1.0}}', '{"4":{"lat":3.0}}']


def feed(path, stations):
    path.write_text(json.dumps({"last_updated": 1, "data": {"stations": stations}}))


def test_feed_folders(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "s").mkdir()
    feed(tmp_path / "i" / "1.json", [{"station_id": "x", "name": "X", "lat": 1, "lon": 2, "capacity": 10}])
    feed(tmp_path / "s" / "1.json", [{"station_id": "x", "num_bikes_available": 4, "last_reported": 7}, {"station_id": "y", "num_bikes_available": 1}])
    info, status = files.read_feed(spark, str(tmp_path / "i"), str(tmp_path / "s"))
    assert info.first().capacity == 10 and status.count() == 2


def test_latest_status_over_batches_and_restart(spark, tmp_path):
    schema = "station_id long, last_reported long, bikes long, ebikes long, docks long, is_renting int"
    src = tmp_path / "in"
    info = spark.createDataFrame([(1, "a", 20), (2, "b", 20)], "station_id long, name string, capacity long")
    spark.createDataFrame([(1, 1, 0, 0, 20, 1), (2, 1, 10, 0, 10, 1)], schema).coalesce(1).write.parquet(str(src / "b1"))
    root = str(tmp_path / "state")
    stream = lambda: live.read_stream(spark, f"{src}/*", spark.createDataFrame([], schema).schema, 1)
    first = live.LatestStatus(spark, info, ORDER, root)
    first.run(stream())
    assert [r.station_id for r in first.board(spark).collect()] == [1]
    spark.createDataFrame([(1, 5, 9, 0, 11, 1), (2, 0, 0, 0, 20, 1)], schema).coalesce(1).write.parquet(str(src / "b2"))
    again = live.LatestStatus(spark, info, ORDER, root)
    again.run(stream())
    assert {r.station_id: (r.last_reported, r.bikes) for r in again.table(spark).collect()} == {1: (5, 9), 2: (1, 10)}
    assert again.board(spark).count() == 0


def test_stage(spark):
    assert stage(spark.range(10), "t").count() == 10


def test_staged_tables_are_removed(spark):
    with staging(spark) as folder:
        t = stage(spark.range(10), "t")
        assert t.count() == 10 and t.inputFiles()[0].removeprefix("file://").startswith(folder.removeprefix("file://"))
    assert not files.exists(spark, folder)
    assert not stage_path(spark, "x").startswith(folder)


def test_mixed_headers_in_one_glob(spark, tmp_path):
    (tmp_path / "b1.csv").write_text("trip_id,member_casual,rideable_type\n1,member,classic\n")
    (tmp_path / "b2.csv").write_text("rideable_type,member_casual,trip_id\nelectric,casual,2\nelectric,casual,3,4,5\n")
    (tmp_path / "b3.csv").write_text("")
    (tmp_path / "b4.csv").write_text("nothing,known\n1,2\n")
    out = files.read_trip_files(spark, [str(tmp_path / "b*.csv")], schemas.TRIPS, corrupt="bad").collect()
    assert sorted((r.trip_id, r.member_casual, r.rideable_type) for r in out if r.bad is None) == [(1, "member", "classic"), (2, "casual", "electric")]
    assert [r.bad for r in out if r.bad] == ["electric,casual,3,4,5"]
    skipped = files.trip_file_headers(spark, [str(tmp_path / "b*.csv")], schemas.TRIPS).where("skipped is not null").collect()
    assert sorted((r.path.rsplit("/")[-1], r.skipped) for r in skipped) == [("b4.csv", "no known column in the header")]  # an empty file has no row


def test_linear_fill_of_many_hours(spark):
    import time

    from dockflow.operators.series import ffill_bfill

    df = spark.range(50_000).selectExpr("id time", "case when id > 40000 and id % 7 = 0 then cast(id as double) end v")
    start = time.time()
    assert ffill_bfill(df, ["v"], "time").where("v is null").count() == 0
    assert time.time() - start < 15
    assert ffill_bfill(df, ["v"], "time").where("time = 3").first().v == 40005.0


def test_feature_list(spark):
    assert len(schemas.FEATURES) == 54 == len(set(schemas.FEATURES))
    df = spark.createDataFrame([(1,)], "hour int")
    assert missing_features(df, ["hour", "temp"]) == ["temp"]
    assert align_features(df, ["temp", "hour"]).first()[:] == (0.0, 1.0)


def test_equality_reaches_the_scan_and_columns_are_pruned(spark):
    df = files.read_station(spark, "/root/testdata/sf0.001/events.parquet", "purchase", key="event_type").select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,purchase)" in plan and "props" not in plan


def test_one_shuffle_for_all_history_windows(spark):
    from dockflow.operators.series import densify
    from dockflow.plans.feature_table import add_history
    s = stage(spark.createDataFrame([("a", dt.datetime(2024, 1, 1), 1)], "station_name string, time timestamp_ntz, pickups long"), "one")
    plan = add_history(densify(s, ["pickups"]))._jdf.queryExecution().sparkPlan()
    text = add_history(densify(s, ["pickups"]))._jdf.queryExecution().executedPlan().toString()
    assert plan is not None and text.count("hashpartitioning(station_name") == 1 and "CartesianProduct" not in text and "NestedLoop" not in text
    assert F is not None


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """Late rows are dropped by the mark of the batches before them, state is kept between runs, and closed windows leave it."""
    schema = "trip_id long, started_at timestamp_ntz, start_station_name string"
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    batches = [[(1, t(1), "a"), (2, t(1, 30), "a")], [(3, t(5), "a"), (1, t(1), "a")], [(4, t(1, 45), "a"), (5, t(4, 30), "a")], [(6, t(9), "a"), (7, t(4, 50), "a")]]
    trips = lambda rows: spark.createDataFrame(rows, schema)
    src, out, once = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "once")
    types = trips([]).schema

    def run(upto):
        for i, rows in enumerate(batches[:upto]):
            if not files.exists(spark, f"{src}/{i}"):
                trips(rows).coalesce(1).write.parquet(f"{src}/{i}")
        live.run_to_table(live.hourly_pickups(live.read_stream(spark, f"{src}/*", types, 1)), "hours", path=out)
        live.run_to_table(live.distinct_trips(live.read_stream(spark, f"{src}/*", types, 1)), "once", path=once)

    run(2)
    assert spark.read.parquet(out).count() == 1  # 1:00 closed at 4:00
    run(4)  # after the restart the mark is 4:00: trip 4 is too late, trip 5 isn't
    got = {(r.time.hour, r.pickups) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 3), (4, 2), (5, 1)}
    assert sorted(r.trip_id for r in spark.read.parquet(once).collect()) == [1, 2, 3, 5, 6, 7]


def test_status_folds_and_writes_changes_only(spark, tmp_path):
    schema = "station_id long, last_reported long, bikes long, ebikes long, docks long, is_renting int"
    info = spark.createDataFrame([(i, "s", 20) for i in range(50)], "station_id long, name string, capacity long")
    src = str(tmp_path / "in")
    state = live.LatestStatus(spark, info, ORDER, str(tmp_path / "state"), fold=2)
    for i in range(5):
        rows = [(k, 0, 10, 0, 10, 1) for k in range(50)] if i == 0 else [(i, i, i, 0, 20 - i, 1), (40, -i, 0, 0, 20, 1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{src}/{i}")
    state.run(live.read_stream(spark, f"{src}/*", spark.createDataFrame([], schema).schema, 1))
    table = {r.station_id: r.bikes for r in state.table(spark).collect()}
    assert len(table) == 50 and [table[i] for i in range(1, 5)] == [1, 2, 3, 4] and table[40] == 10
    assert state.changes.numbers(spark) == [0, 1, 2, 3, 4] and state.folded.numbers(spark) == [1, 3]
    assert state.changes.read(spark, [3]).count() <= 2  # not the whole table


def test_last_good_feed_is_served(spark, tmp_path):
    schema = schemas.T.StructType([schemas.T.StructField("station_id", schemas.T.StringType()), schemas.T.StructField("bikes", schemas.T.LongType())])
    feed_table = live.FeedTable(spark, schema, "station_id", str(tmp_path / "feed"))
    assert feed_table.served(spark) is None
    land = tmp_path / "land"
    land.mkdir()
    lines = [['{"station_id":"x","bikes":1}', '{"station_id":"y","bikes":2}'], ['{"station_id":"x","bikes":5}', '{"station_id":"y","bik'], [], ['{"station_id":"x","bikes":7}', '{"station_id":"x","bikes":8}'], ['{"bikes":3}']]
    served = []
    for i, text in enumerate(lines):
        (land / f"{i}.json").write_text("\n".join(text))
        feed_table.run(spark, str(land))
        served.append(sorted((r.station_id, r.bikes, r.version) for r in feed_table.served(spark).collect()))
    assert served == [[("x", 1, 0), ("y", 2, 0)]] * 5
    (land / "9.json").write_text('{"station_id":"z","bikes":4}')
    feed_table.run(spark, str(land))
    assert [(r.station_id, r.bikes) for r in feed_table.served(spark).collect()] == [("z", 4)]
    notes = {r.note for r in feed_table.versions.listed(spark).where("not good").collect()}
    assert {"1 broken lines", "a key twice", "rows without a key"} <= notes


def test_buckets_are_pruned(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("station "), F.col("id") % 40).alias("station_name"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("time"), F.col("id").alias("pickups"))
    path = str(tmp_path / "history")
    sinks.write_buckets(rows, path, buckets=8)
    auto = "spark.sql.sources.bucketing.autoBucketedScan.enabled"  # else the plan doesn't tell the buckets of a scan that needs no exchange
    spark.conf.set(auto, "false")
    try:
        table = sinks.open_buckets(spark, path).where("station_name = 'station 7'")
        plan = table._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(auto)
    assert table.count() == 125 and "SelectedBucketsCount: 1 out of 8" in plan and "EqualTo(station_name,station 7)" in plan
