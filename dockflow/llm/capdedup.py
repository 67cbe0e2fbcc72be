"""Near-duplicate vectors by spherical-cap filters.

A random product code gives very many directions: every choice of one code vector per block of coordinates is a filter. Each vector is
list-decoded to all filters whose direction it exceeds a threshold with; near vectors share some filter, others hardly ever do.

Dense groups aren't expanded into pairs. A vector joins the ball of the first vector of one of its filters that is within half the
linking angle, so members of a ball are linked with each other. Balls that share a filter are compared by centre and radius first, then
members with balls, and only what is still open pair by pair. Links that are counted are exact; what the filters miss is measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dockflow.llm.shared import components, stage

LEAST = 0.93
ROTATIONS, FILTERS = 10, 8  # codes, each of rotated coordinates, and filters of each that a vector of random direction exceeds on average
PER_ROW, LARGEST_CODE, LEAST_THIRD = 20, 4096, 48  # filters of a code for each vector; code vectors of a block before a third one is made, with so many coordinates
WIDE = 0.75  # of the linking angle: the radius of a cap where so many coordinates are few that narrower ones would part near vectors
MARGIN = 1e-6  # of angles; what is closer to a border is left to the exact comparison


def cap_share(dim: int, radius: float) -> float:
    """Share of the sphere's directions within an angle of a fixed one."""
    if dim == 1:
        return 0.5
    x = (np.arange(20_000) + 0.5) / 20_000
    return float((np.sin(radius * x) ** (dim - 2)).sum() * radius / ((np.sin(np.pi * x) ** (dim - 2)).sum() * np.pi))


@lru_cache(maxsize=64)
def shape(dim: int, rows: int, theta: float) -> tuple[int, int, float | None]:
    """(blocks, code vectors of each, threshold) for vectors of ``dim`` coordinates.

    The filters grow with the rows, so a filter has as many vectors in a large table as in a small one, from some million rows on by a
    third block of coordinates; but caps never get so narrow that near vectors have none in common, which limits their number where coordinates are
    few. If that is very few, one block of caps with their own threshold covers the sphere. Otherwise the threshold follows from the
    average number of filters.
    """
    few = FILTERS / cap_share(dim, WIDE * theta)
    if few <= LARGEST_CODE:
        return 1, max(2 * dim, int(np.ceil(few))), float(np.cos(WIDE * theta))
    total = min(rows * PER_ROW, FILTERS / cap_share(dim, theta))
    blocks = 2 if total <= LARGEST_CODE**2 or dim < LEAST_THIRD else 3
    return blocks, max(64, int(np.ceil(total ** (1 / blocks)))), None


@lru_cache(maxsize=64)
def code(dim: int, rotation: int, blocks: int, size: int, least: float | None) -> tuple[np.ndarray, list[np.ndarray], list[slice], float]:
    """Rotation, code vectors of each block, the blocks' coordinates and the threshold, the same everywhere for one shape."""
    rng = np.random.default_rng([dim, rotation])
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    at, parts, slices = 0, [], []
    for n in [len(x) for x in np.array_split(np.arange(dim), min(blocks, dim))]:
        c = rng.standard_normal((size, n))
        parts.append(c / np.linalg.norm(c, axis=1, keepdims=True))
        slices.append(slice(at, at + n))
        at += n
    if least is None:
        u = rng.standard_normal((24, dim))
        best = []
        for x in u / np.linalg.norm(u, axis=1, keepdims=True):
            # the largest sums of one score of each block; smaller scores than the first FILTERS * 24 of a block aren't among them
            total = np.zeros(1)
            for c, s in zip(parts, slices):
                scores = np.sort(c @ x[s])[::-1][:FILTERS * len(u)]
                total = np.sort((total[:, None] + scores[None, :]).ravel())[::-1][:FILTERS * len(u)]
            best.append(total)
        every = np.sort(np.concatenate(best))[::-1]
        least = float(every[min(FILTERS * len(u), len(every)) - 1])
    return turn, parts, slices, least


def decode(x: np.ndarray, blocks: int, size: int, threshold: float | None) -> np.ndarray:
    """All filters that a unit vector exceeds, and the best one of each rotation; partial sums that can't reach the threshold any more are left early."""
    out = []
    for rotation in range(ROTATIONS):
        turn, parts, slices, least = code(len(x), rotation, blocks, size, threshold)
        y = turn @ x
        scores = [c @ y[s] for c, s in zip(parts, slices)]
        rest = np.cumsum([0.0] + [s.max() for s in scores[:0:-1]])[::-1]
        ids, sums, best = np.full(1, rotation, np.int64), np.zeros(1), rotation
        for s, r in zip(scores, rest):
            near = np.flatnonzero(s >= least - r - sums.max(initial=0.0))
            total = sums[:, None] + s[None, near]
            a, b = np.nonzero(total >= least - r)
            ids, sums, best = ids[a] * size + near[b], total[a, b], best * size + int(s.argmax())
        out.append(ids if best in ids else np.append(ids, best))
    return np.concatenate(out)


def vectors(table: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v): one row for each id with a label and a usable vector; of rows with one id the first by content."""
    v = F.col(vector).cast("array<double>")
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    fine &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", F.col("x.v").alias("v"))


def _units(column: pa.Array) -> list[np.ndarray]:
    out = []
    for x in column:
        x = np.asarray(x.values, float)
        x = x / np.abs(x).max()
        out.append(x / np.linalg.norm(x))
    return out


def filters(vecs: DataFrame, rows: int, theta: float) -> DataFrame:
    """(label, dim, filter, vec_id): the filters of every vector; ``rows`` is about the number of vectors."""
    kind = vecs.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            found = [decode(u, *shape(len(u), rows, theta)) for u in _units(b.column("v"))]
            at = pa.array(np.repeat(np.arange(b.num_rows), [len(f) for f in found]))
            dims = pa.array([len(x) for x in b.column("v")], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("label").take(at), dims.take(at), pa.array(np.concatenate([np.zeros(0, np.int64), *found])), b.column("vec_id").take(at)], names=["label", "dim", "filter", "vec_id"])

    return vecs.select("vec_id", "label", "v").mapInArrow(run, f"label {kind}, dim int, filter long, vec_id long")


def with_cosine(pairs: DataFrame) -> DataFrame:
    """Adds ``cosine`` of the vectors ``v`` and ``w``, in doubles, in place of both. Vectors of different lengths have none."""
    cols = [c for c in pairs.columns if c not in ("v", "w")]
    schema = ", ".join(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in cols) + ", cosine double"

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = []
            for x, y in zip(b.column("v"), b.column("w")):
                x, y = np.asarray(x.values, float), np.asarray(y.values, float)
                out.append(float(x @ y / np.sqrt((x @ x) * (y @ y))) if len(x) == len(y) else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(out, pa.float64())], names=[*cols, "cosine"])

    return pairs.mapInArrow(run, schema)


def angle(cosine: str) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(cosine))))


def near_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """(key, n_links, component_id, kept) of each vector: links to others of the same label with a cosine of at least ``least``.

    Vectors without a label, null, zero, or with null or non-finite components link with nothing, nor do vectors of different lengths.
    Rows with one id are one vector; a row without an id links with nothing and has no component. Other columns are left out; an empty
    table gives no rows. Equal vectors of a label are folded into one with their number first, so copies cost nothing.
    """
    theta = float(np.arccos(least))
    each = stage(vectors(table, key, vector, label), "caps-each")
    v = stage(each.groupBy("label", "v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "caps-vectors")
    f = stage(filters(v, 1 << max(9, v.count()).bit_length(), theta), "caps-filters")
    # the first vector of each filter, offered as centre to the others
    first = f.groupBy("label", "dim", "filter").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    f = stage(f.join(first, ["label", "dim", "filter"]), "caps-shared")
    offers = f.where("first < vec_id").select("vec_id", "first").distinct()
    offers = with_cosine(offers.join(v.select("vec_id", "v"), "vec_id").join(v.select(F.col("vec_id").alias("first"), F.col("v").alias("w")), "first"))
    offers = offers.withColumn("angle", angle("cosine")).where(F.col("angle") <= theta / 2 - MARGIN)
    chosen = offers.groupBy("vec_id").agg(F.min(F.struct("first", "angle")).alias("o")).select("vec_id", F.col("o.first").alias("ball"), F.col("o.angle").alias("angle"))
    member = stage(v.select("vec_id", "v", "copies").join(chosen, "vec_id", "left").select("vec_id", "v", "copies", F.coalesce("ball", "vec_id").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "caps-members")
    ball = stage(member.groupBy("ball").agg(F.sum("copies").alias("size"), F.max("angle").alias("radius")).join(v.select(F.col("vec_id").alias("ball"), F.col("v").alias("centre")), "ball"), "caps-balls")
    # pairs of balls that share a filter
    seen = f.join(member.select("vec_id", "ball"), "vec_id").select("label", "dim", "filter", "ball").distinct()
    seen = stage(seen, "caps-matrix")
    pairs = seen.join(seen.withColumnRenamed("ball", "other"), ["label", "dim", "filter"]).where("ball < other").select("ball", "other").distinct()
    a, b = ball.toDF("ball", "size", "radius", "v"), ball.toDF("other", "other_size", "other_radius", "w")
    pairs = with_cosine(pairs.join(a, "ball").join(b, "other")).withColumn("angle", angle("cosine"))
    both = F.col("radius") + F.col("other_radius")
    pairs = stage(pairs.where(F.col("angle") - both <= theta + MARGIN).withColumn("all", F.col("angle") + both <= theta - MARGIN), "caps-pairs")
    mirror = pairs.select("ball", "other", "all", F.col("other_size").alias("n"), F.col("other_radius").alias("r")).unionByName(
        pairs.select(F.col("other").alias("ball"), F.col("ball").alias("other"), "all", F.col("size").alias("n"), F.col("radius").alias("r")))
    whole = mirror.where("all").groupBy("ball").agg(F.sum("n").alias("links"))  # each member links with all of these
    # members against balls, then pair by pair
    left = mirror.where("not all").select("ball", "other", "n", "r").join(member.select("ball", "vec_id", "v"), "ball").join(ball.select(F.col("ball").alias("other"), F.col("centre").alias("w")), "other")
    left = stage(with_cosine(left).withColumn("angle", angle("cosine")), "caps-left")
    inside = left.where(F.col("angle") + F.col("r") <= theta - MARGIN).select("vec_id", "ball", "other", "n")
    open_ = left.where((F.col("angle") + F.col("r") > theta - MARGIN) & (F.col("angle") - F.col("r") <= theta + MARGIN)).select("vec_id", "ball", "other")
    open_ = open_.join(v.select("vec_id", "v"), "vec_id").join(member.select(F.col("ball").alias("other"), F.col("v").alias("w"), F.col("copies").alias("m")), "other")
    exact = with_cosine(open_).where(F.col("cosine") >= least).groupBy("vec_id", "ball", "other").agg(F.sum("m").alias("n"))
    single = stage(inside.unionByName(exact), "caps-single")
    own = single.groupBy("vec_id").agg(F.sum("n").alias("own"))
    edges = pairs.where("all").select(F.col("ball").alias("a"), F.col("other").alias("b")).unionByName(single.select(F.col("ball").alias("a"), F.col("other").alias("b")))
    # balls stand for their members; a centre may lie in another ball, so balls are numbered by their smallest member
    least_of = stage(member.groupBy("ball").agg(F.min("vec_id").alias("low")), "caps-low")
    edges = edges.join(least_of.toDF("a", "x"), "a").join(least_of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    of_low = components(edges, "caps").withColumnRenamed("node", "low")
    of_ball = least_of.join(of_low, "low", "left").select("ball", F.coalesce("component", "low").alias("component"))
    done = (member.select("vec_id", "ball").join(ball.select("ball", "size"), "ball").join(whole, "ball", "left").join(of_ball, "ball").join(own, "vec_id", "left")
            .select("vec_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("n_links"), "component"))
    done = each.join(v.select("label", "v", F.col("vec_id").alias("first")), ["label", "v"]).select("vec_id", "first").join(done.withColumnRenamed("vec_id", "first"), "first").drop("first")
    ids = table.select(F.col(key).cast("long").alias("vec_id"))
    every = ids.where("vec_id is not null").distinct().unionByName(ids.where("vec_id is null"))
    return every.join(done, "vec_id", "left").select(
        F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(False)).alias("kept"))
