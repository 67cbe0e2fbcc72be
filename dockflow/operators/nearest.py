"""Exact nearest rows in a few dimensions: an adaptive tree of boxes, kept as tables, and equality joins down its levels.

Only crowded boxes are split, at quantiles of their own rows along their widest side, so a far outlier costs one box and a dense area gets
many. Every box is as tight as its rows. A query first walks to the box it belongs to; the smallest box on its way that holds enough
rows bounds its distance, and the rows of its own last box, a fixed number at most, bound it by their distances. Then it goes down
again into every box that the bound reaches, and only the rows of the last boxes are compared. No row meets a table of all rows,
nothing is sent through the driver, and nothing is approximate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dockflow.session import stage

FAN = 16  # parts that a crowded box is split into
LEAF = 64  # rows of a box that isn't split
SMALL_LEVELS = 3  # levels of at most FAN ** 3 boxes, which are broadcast
DEEPEST = 1 << 56  # numbers of boxes stay in 64 bits
SLACK = 1 + 1e-9  # of squared distances, so that rounding never closes a box that holds a tie


@dataclass
class Tree:
    """``levels``: the boxes of each level (node, n, weight, lo, hi, dim, splits); ``rows`` (p, x, w, node): each row with its last box."""

    dims: int
    levels: list[DataFrame]
    rows: DataFrame


def _side(row: str, i: int) -> Column:
    return F.get(row, F.lit(i))


def _small(level: DataFrame, depth: int) -> DataFrame:
    return F.broadcast(level) if depth <= SMALL_LEVELS else level


def build(rows: DataFrame, dims: int, leaf: int = LEAF) -> Tree:
    """The tree of ``rows`` (p, x, w): a payload, an array of ``dims`` doubles without nulls, a weight. Rows should have different x.

    Splits are values of rows, found by mergeable sketches, so every part has rows; a box whose rows are all at one place stays whole.
    A box of few rows is split into fewer parts, so that the last boxes are about half full at least.
    """
    fractions = [i / FAN for i in range(1, FAN)]
    live, levels, done = rows.select("p", "x", "w", F.lit(1).cast("long").alias("node")), [], []
    while True:
        sides = [F.struct(F.min(_side("x", i)).alias("lo"), F.max(_side("x", i)).alias("hi"), F.percentile_approx(_side("x", i), fractions, 1000).alias("q")) for i in range(dims)]
        boxes = live.groupBy("node").agg(F.count("*").alias("n"), F.sum("w").alias("weight"), F.array(*sides).alias("s"))
        widest = F.array_max(F.array(*[F.struct((_side("s", i)["hi"] - _side("s", i)["lo"]).alias("size"), F.lit(-i).alias("less")) for i in range(dims)]))
        boxes = boxes.withColumn("widest", widest).withColumn("dim", -F.col("widest.less"))
        cut = F.get("s", F.col("dim"))
        parts = F.greatest(F.lit(2), F.least(F.lit(FAN), F.floor(2 * F.col("n") / leaf))).cast("int")
        chosen = F.transform(F.sequence(F.lit(1), parts - 1), lambda i: F.get(cut["q"], F.floor(i * FAN / parts).cast("int") - 1))
        inner = F.array_distinct(F.filter(chosen, lambda v: v < cut["hi"]))
        splits = F.when((F.col("n") > leaf) & (F.col("widest.size") > 0) & (F.col("node") < DEEPEST), F.when(F.size(inner) > 0, inner).otherwise(F.array(cut["lo"])))
        level = stage(boxes.select("node", "n", "weight", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"), "dim", splits.alias("splits")), "nearest-level")
        levels.append(level)
        if not level.where("splits is not null").head(1):
            done.append(live)
            break
        child = F.col("node") * FAN + _part("splits")
        placed = live.join(_small(level.select("node", "dim", "splits"), len(levels) - 1), "node")
        moved = stage(placed.select("p", "x", "w", F.coalesce(child, "node").alias("node"), F.col("splits").isNull().alias("done")), "nearest-rows")
        done.append(moved.where("done").drop("done"))
        live = moved.where("not done").drop("done")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return Tree(dims, levels, out)


def _part(splits: str) -> Column:
    """The part of a box that ``x`` belongs to; null in a box that isn't split."""
    return F.when(F.col(splits).isNotNull(), F.size(F.filter(splits, lambda v: v < F.get("x", F.col("dim")))))


def _square(gaps: list[Column]) -> Column:
    return sum((F.pow(g, F.lit(2)) for g in gaps[1:]), F.pow(gaps[0], F.lit(2)))


def squared_distance(a: str, b: str, dims: int) -> Column:
    return _square([_side(a, i) - _side(b, i) for i in range(dims)])


def candidates(queries: DataFrame, tree: Tree, need: int = 1) -> DataFrame:
    """(q, x, p, y, w, d2): for each query (q, x) all rows that may be among its nearest of total weight ``need``, ties included.

    The bound is the least of the greatest distances to the boxes on the query's way that hold the weight, and of the distance at which the
    rows of its last box have the weight: a box can be long, or far from the query, and then its corners say little. Without such a box
    (fewer rows than needed) all rows remain. The first levels are broadcast, their number of boxes being fixed; from then on queries
    are spread over thousands of boxes and joined by equality.
    """
    dims = tree.dims
    far = _square([F.greatest(F.abs(_side("x", i) - _side("lo", i)), F.abs(_side("x", i) - _side("hi", i))) for i in range(dims)])
    way = queries.select("q", "x", F.lit(1).cast("long").alias("node"), F.lit(float("inf")).alias("bound"))
    for depth, level in enumerate(tree.levels):
        at = way.join(_small(level.select("node", "weight", "lo", "hi", "dim", "splits"), depth), "node", "left")
        bound = F.least("bound", F.when(F.col("weight") >= need, far))
        way = at.select("q", "x", F.coalesce(F.col("node") * FAN + _part("splits"), "node").alias("node"), bound.alias("bound"))
    own = tree.rows.groupBy("node").agg(F.collect_list(F.struct("x", "w")).alias("own"))
    way = way.join(own, "node", "left").select("q", "x", F.least("bound", _own_bound(need, dims)).alias("bound"))
    near = _square([F.greatest(_side("lo", i) - _side("x", i), _side("x", i) - _side("hi", i), F.lit(0.0)) for i in range(dims)])
    open_ = way.select("q", "x", "bound", F.lit(1).cast("long").alias("node"))
    for depth, level in enumerate(tree.levels[1:], 1):
        boxes = level.select(F.shiftright("node", FAN.bit_length() - 1).alias("node"), F.col("node").alias("child"), "lo", "hi")
        reached = open_.join(_small(boxes, depth), "node", "left").where(F.col("child").isNull() | (near <= F.col("bound") * SLACK))
        open_ = reached.select("q", "x", "bound", F.coalesce("child", "node").alias("node"))
    found = open_.join(tree.rows.select("node", "p", F.col("x").alias("y"), "w"), "node").withColumn("d2", squared_distance("x", "y", dims))
    return found.where(F.col("d2") <= F.col("bound") * SLACK).select("q", "x", "p", "y", "w", "d2")


def _own_bound(need: int, dims: int) -> Column:
    """The squared distance from ``x`` at which the rows in ``own`` (x, w) first have the weight ``need``; null if they never have."""
    d2 = lambda r: _square([_side("x", i) - F.get(r["x"], F.lit(i)) for i in range(dims)])
    if need == 1:  # any one row has it: no order is needed
        return F.array_min(F.transform("own", lambda r: F.when(r["w"] >= need, d2(r))))
    gap = lambda r: F.struct(d2(r).alias("d2"), r["w"].cast("long").alias("w"))
    start = F.struct(F.lit(0).cast("long").alias("w"), F.lit(None).cast("double").alias("d2"))
    step = lambda a, r: F.struct((a["w"] + r["w"]).alias("w"), F.when(a["w"] < need, r["d2"]).otherwise(a["d2"]).alias("d2"))
    return F.aggregate(F.array_sort(F.transform("own", gap)), start, step, lambda a: F.when(a["w"] >= need, a["d2"]))


def neighbourhoods(queries: DataFrame, tree: Tree, need: int) -> DataFrame:
    """(q, p, w, d2): the rows within the distance at which a query's nearest rows first have the total weight ``need``; all of them if they never have."""
    c = candidates(queries.repartition("q"), tree, need)  # few bytes may be much work, and the windows need them by query
    upto = F.sum("w").over(Window.partitionBy("q").orderBy("d2").rangeBetween(Window.unboundedPreceding, 0))
    reach = F.min(F.when(F.col("upto") >= need, F.col("d2"))).over(Window.partitionBy("q"))
    return c.withColumn("upto", upto).withColumn("reach", reach).where("reach is null or d2 <= reach").select("q", "p", "w", "d2")
