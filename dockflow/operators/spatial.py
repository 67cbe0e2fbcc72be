"""Spatial operators on planar cells: box join, nearest station, value match, density grid and hexagons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.operators.nearest import build, candidates


def cell(col: Column, size: float) -> Column:
    return F.floor(col / F.lit(size))


def _around(df: DataFrame, size: float) -> DataFrame:
    """Each row once for its own cell and the eight around it."""
    offsets = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return (df.withColumn("_dx", F.explode(offsets)).withColumn("_dy", F.explode(offsets))
            .withColumn("_cx", cell(F.col("lon"), size) + F.col("_dx")).withColumn("_cy", cell(F.col("lat"), size) + F.col("_dy"))
            .drop("_dx", "_dy"))


def stations_near(centres: DataFrame, stations: DataFrame, radius: float) -> DataFrame:
    """Stations whose coordinates differ from a centre by less than ``radius`` in both directions.

    Both sides get a cell of that size; stations are repeated into the neighbouring cells, rows meet by equal cell and
    the exact condition is checked on the few candidates.
    """
    s = _around(stations.select("station_name", "lat", "lon"), radius)
    c = (centres.select("centre_id", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
         .withColumn("_cx", cell(F.col("c_lon"), radius)).withColumn("_cy", cell(F.col("c_lat"), radius)))
    near = (F.abs(F.col("lon") - F.col("c_lon")) < radius) & (F.abs(F.col("lat") - F.col("c_lat")) < radius)
    return c.join(s, ["_cx", "_cy"]).where(near).select("centre_id", "station_name")


STATIONS_LEAF = 16  # places of a box of the tree that isn't split


def nearest_station(points: DataFrame, stations: DataFrame, leaf: int = STATIONS_LEAF) -> DataFrame:
    """Nearest station of each point (``point_id``, lat, lon) by planar distance in degrees, ties by name; exact.

    Stations are kept in an adaptive tree of boxes. A point goes down the boxes that can hold its nearest station and is compared with the
    places of the last ones, ``leaf`` each at most, so stations or points far away from all others cost nothing extra; candidates are
    reduced to the nearest in the task that found them. Stations at the same position are folded to the first name. A point
    without a position, or any point if there is no station, has no nearest one.
    """
    places = (stations.where("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.min("station_name").alias("p"))
              .select("p", F.array(F.col("lon").cast("double"), F.col("lat").cast("double")).alias("x"), F.lit(1).cast("long").alias("w")))
    known = points.where("lat is not null and lon is not null").select(F.col("point_id").alias("q"), F.array(F.col("lon").cast("double"), F.col("lat").cast("double")).alias("x"))
    tree = build(places, 2, leaf)
    found = candidates(known, tree).select(F.col("q").alias("point_id"), F.struct("d2", "p").alias("m"))
    none = points.select("point_id", F.lit(None).cast(found.schema["m"].dataType).alias("m"))
    best = found.unionByName(none).groupBy("point_id").agg(F.min("m").alias("m"))
    return best.select("point_id", F.col("m.p").alias("station_name"), F.sqrt("m.d2").alias("dist"))


def match_by_volume(targets: DataFrame, stations: DataFrame, share: float = 0.1) -> DataFrame:
    """Station whose trip count is closest to a target; only if the difference is below ``share`` of the target.

    An accepted station lies within the share, hence in the target's logarithmic bucket or a neighbouring one. In the own
    bucket the closest values below and above come from one pass in either order; from the neighbours only their largest and
    smallest value matter. Equal values are folded first (first name wins; of two equally close values the smaller).
    """
    width = math.log1p(share) - math.log1p(-share)
    bucket = lambda c: F.floor(F.log(c.cast("double")) / F.lit(width))
    s = (stations.where("trip_count > 0").groupBy(F.col("trip_count").cast("double").alias("v"))
         .agg(F.min("station_name").alias("name")).withColumn("b", bucket(F.col("v"))))
    t = targets.where("target > 0").select(F.col("target").cast("double").alias("v")).distinct().withColumn("b", bucket(F.col("v")))
    hit = F.struct("v", "name")
    both = s.select("b", "v", hit.alias("s"), F.lit(0).alias("is_t")).unionByName(
        t.select("b", "v", F.lit(None).cast("struct<v:double,name:string>").alias("s"), F.lit(1).alias("is_t")))
    w = Window.partitionBy("b").orderBy("v", "is_t").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("b").orderBy(F.desc("v"), F.desc("is_t")).rowsBetween(Window.unboundedPreceding, 0)
    own = (both.withColumn("lo", F.last("s", True).over(w)).withColumn("hi", F.last("s", True).over(down))
           .where("is_t = 1").select("b", F.col("v").alias("target"), "lo", "hi"))
    edges = s.groupBy("b").agg(F.min(hit).alias("least"), F.max(hit).alias("most"))
    below = edges.select((F.col("b") + 1).alias("b"), F.col("most").alias("prev"))
    above = edges.select((F.col("b") - 1).alias("b"), F.col("least").alias("next"))
    cand = own.join(below, "b", "left").join(above, "b", "left")
    options = F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.v") - F.col("target")).alias("diff"), F.col(f"{c}.v").alias("v"), F.col(f"{c}.name").alias("name")))
                        for c in ("lo", "hi", "prev", "next")])
    best = cand.withColumn("m", F.array_min(F.filter(options, lambda o: o.isNotNull())))
    best = best.where(F.col("m.diff") < F.col("target") * share).select("target", F.col("m.name").alias("station_name"), F.col("m.diff").alias("diff"))
    return targets.select("target").distinct().withColumn("target", F.col("target").cast("double")).join(best, "target", "left")


def density(points: DataFrame, size: float, weight: str = "weight") -> DataFrame:
    """Sum of weights per square cell."""
    return (points.groupBy(cell(F.col("lat"), size).alias("cell_y"), cell(F.col("lon"), size).alias("cell_x"))
            .agg(F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n")))


def hexbin(points: DataFrame, radius_m: float = 200.0, lat0: float = 40.7, weight: str = "weight", names: str | None = None) -> DataFrame:
    """Sum of weights per pointy-top hexagon of the given radius on a local plane around ``lat0``.

    Axial coordinates are rounded through cube coordinates: round all three, then repair the one that moved most.
    """
    metre = 111_320.0
    x = F.col("lon") * F.lit(metre * math.cos(math.radians(lat0)))
    y = F.col("lat") * F.lit(metre)
    q = (F.lit(math.sqrt(3) / 3) * x - F.lit(1 / 3) * y) / F.lit(radius_m)
    r = (F.lit(2 / 3) * y) / F.lit(radius_m)
    p = points.withColumn("_q", q).withColumn("_r", r)
    rq, rr, rs = F.floor(F.col("_q") + 0.5), F.floor(F.col("_r") + 0.5), F.floor(-F.col("_q") - F.col("_r") + 0.5)
    p = p.withColumn("_rq", rq).withColumn("_rr", rr).withColumn("_rs", rs)
    dq, dr, ds = F.abs(F.col("_rq") - F.col("_q")), F.abs(F.col("_rr") - F.col("_r")), F.abs(F.col("_rs") + F.col("_q") + F.col("_r"))
    hq = F.when((dq > dr) & (dq > ds), -F.col("_rr") - F.col("_rs")).otherwise(F.col("_rq"))
    hr = F.when((dq > dr) & (dq > ds), F.col("_rr")).when(dr > ds, -F.col("_rq") - F.col("_rs")).otherwise(F.col("_rr"))
    aggs = [F.sum(weight).alias("weight"), F.count(F.lit(1)).alias("n")]
    if names:
        aggs.append(F.count_distinct(names).alias("n_stations"))
    return p.groupBy(hq.alias("hex_q"), hr.alias("hex_r")).agg(*aggs)
