"""Exact quantiles by merged sketches and narrowed brackets, and one-row aggregates used as scalars."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from dockflow.session import stage

SKETCH, ERROR = 4096, 0.002  # size of a sketch, and the rank error that it keeps nearly always
STEPS, SALTS = 512, 64  # steps that a sketch is read at; groups of tasks whose sketches are merged first
MOST_ROWS = 20_000  # rows of a bracket that is ordered


def scalar_struct(one_row: DataFrame) -> Column:
    """A one-row frame as a scalar subquery; read its columns with ``getField``. No join is planned for it."""
    return one_row.select(F.struct(*one_row.columns).alias("s")).scalar()


def attach(df: DataFrame, one_row: DataFrame, name: str = "_s") -> DataFrame:
    """Add a one-row frame as a struct column, so that several expressions share one subquery; drop it after use.

    Take the row from the original table rather than from a frame that carries other subqueries: plans stay small.
    """
    return df.withColumn(name, scalar_struct(one_row))


def aggregate(df: DataFrame, aggs: list[Column], at_once: int = 16) -> DataFrame:
    """One row of many aggregates, a few in a pass: a pass reads its own columns only and its generated code stays small enough to be compiled.

    ``df`` is read in every pass and should be staged.
    """
    parts = [df.agg(*aggs[i:i + at_once]) for i in range(0, len(aggs), at_once)]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)
    return out


@dataclass
class Target:
    """A wanted quantile: its column, its position in order (from 0, with a fraction), and the values it lies between."""

    column: str
    q: float
    position: float = 0.0
    low: float = -math.inf
    high: float = math.inf
    rows: float = math.inf  # that the bracket holds, as far as the sketch tells
    margin: float = ERROR

    @property
    def bracket(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high

    def narrow(self, r: Row, whole: bool) -> None:
        """A narrower bracket by the sketch of this one. If exact counts show that the position lies outside, all values are open again."""
        if whole:
            self.position = (r["n"] - 1) * self.q
        below, last = math.floor(self.position) - r["less"], math.ceil(self.position) - r["less"]
        if not r["n"]:
            self.rows = 0
        elif below < 0 or last >= r["n"]:
            self.reopen()
        else:
            old, at, top = self.bracket, r["at"], len(r["at"]) - 1
            i, j = math.floor((below / r["n"] - self.margin) * top), math.ceil(((last + 1) / r["n"] + self.margin) * top)
            self.low, self.high = at[i] if i > 0 else self.low, at[j] if j < top else self.high
            self.rows = 1 if self.low == self.high or self.bracket == old else (min(j, top) - max(i, 0)) / top * r["n"]

    def reopen(self) -> None:
        """All values again, with a wider margin: a sketch was off by more than the last one."""
        self.low, self.high, self.rows, self.margin = -math.inf, math.inf, math.inf, 4 * self.margin


def _long(base: DataFrame, sides: list[Column]) -> DataFrame:
    """A row for each value and bracket; values above the bracket are left out."""
    return base.select(F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"), F.explode(F.array(*sides)).alias("v")).select("salt", "v.*")


def _sketched(base: DataFrame, brackets: list[tuple[str, float, float]]) -> list[Row]:
    """For each bracket: how many values lie below and inside, and a sketch of those inside, read at STEPS even steps. In one pass.

    Sketches have a fixed size and are merged by salted group before one task merges the groups', so it sees SALTS of them."""
    x = lambda c, low, high: F.when((F.col(c) >= low) & (F.col(c) <= high), F.col(c))
    sides = [F.struct(F.lit(i).alias("i"), x(c, low, high).alias("x"), (F.col(c) < low).alias("below")) for i, (c, low, high) in enumerate(brackets)]
    parts = _long(base, sides).groupBy("i", "salt").agg(F.count("x").alias("n"), F.count_if("below").alias("less"), F.kll_sketch_agg_double("x", F.lit(SKETCH)).alias("s"))
    merged = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("less").alias("less"), F.kll_merge_agg_double("s", F.lit(SKETCH)).alias("s"))
    steps = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    found = merged.select("i", "n", "less", F.when(F.kll_sketch_get_n_double("s") > 0, F.kll_sketch_get_quantile_double("s", steps)).alias("at")).collect()
    by = {r["i"]: r for r in found}
    return [by.get(i, {"n": 0, "less": 0, "at": None}) for i in range(len(brackets))]


def _ordered(base: DataFrame, targets: dict[str, Target]) -> dict[str, float | None]:
    """The values at the targets' positions: those inside the brackets are folded into counts and ordered, the others counted."""
    x = lambda t: F.col(t.column)
    sides = [F.struct(F.lit(name).alias("name"), F.lit(t.position).alias("position"), x(t).alias("x"), F.when(x(t) < t.low, 0).when(x(t) > t.high, 2).otherwise(1).alias("side"))
             for name, t in targets.items()]
    rows = _long(base, sides).where("x is not null").withColumn("v", F.when(F.col("side") == 1, F.col("x")))
    counts = rows.groupBy("name", "position", "side", "v").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    w = Window.partitionBy("name").orderBy("side", "v").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("end", F.sum("n").over(w)).withColumn("start", F.col("end") - F.col("n"))
    # values beside the bracket are known where they border on it
    value = lambda at: F.max(F.when((at >= F.col("start")) & (at < F.col("end")), F.when(F.col("side") == 1, F.col("v"))
                                    .when((F.col("side") == 0) & (at == F.col("end") - 1), F.col("most")).when((F.col("side") == 2) & (at == F.col("start")), F.col("least"))))
    found = upto.groupBy("name").agg(value(F.floor("position")).alias("a"), value(F.ceil("position")).alias("b")).collect()
    ends = {r["name"]: (r["a"], r["b"]) for r in found if r["a"] is not None and r["b"] is not None}
    return {name: a + (b - a) * (targets[name].position % 1) if a != b else a for name, (a, b) in ends.items()}


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]], most: int = MOST_ROWS) -> DataFrame:
    """One row with exact, linearly interpolated quantiles; ``wanted`` maps output name to (column, quantile).

    One pass takes mergeable sketches of the columns, which bracket all wanted positions. A bracket with more than ``most`` rows is
    sketched again by itself, all such brackets in one pass, until it holds fewer; then only its values, folded into counts, are
    ordered. Exact counts check the positions, so the result does not depend on the sketches: a bracket that missed is opened again.
    The columns are staged once, as they are read two or more times. Nulls and NaN are left out; a column
    without values has null.
    """
    columns = sorted({c for c, _ in wanted.values()})
    base = stage(df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]), "quantile-columns")
    targets, values = {name: Target(c, float(q)) for name, (c, q) in wanted.items()}, {}
    while left := {name: t for name, t in targets.items() if name not in values and t.rows > 0}:
        while crowded := [t for t in left.values() if t.rows > most]:
            brackets = sorted({t.bracket for t in crowded})
            rows = dict(zip(brackets, _sketched(base, brackets)))
            for t in crowded:
                t.narrow(rows[t.bracket], math.isinf(t.low) and math.isinf(t.high))
        left = {name: t for name, t in left.items() if t.rows > 0}
        if left:
            values |= _ordered(base, left)
            for name in left.keys() - values.keys():
                targets[name].reopen()
    return df.sparkSession.range(1).select(*[F.lit(values.get(name)).cast("double").alias(name) for name in wanted])


def bounded_quantiles(df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """The same for columns with few distinct values (counts of trips, one value per hour): one aggregate.

    Its buffer holds one counter per distinct value, whatever the number of rows.
    """
    return df.agg(*[F.percentile(c, q).alias(name) for name, (c, q) in wanted.items()])


def fill_median(df: DataFrame, cols: list[str], source: DataFrame | None = None, few_values: bool = False) -> DataFrame:
    """Replace nulls by the exact median of each column (of ``source`` if given)."""
    quantiles = bounded_quantiles if few_values else exact_quantiles
    med = quantiles(source if source is not None else df, {c: (c, 0.5) for c in cols})
    out = [F.coalesce(F.col(c), F.col(f"_s.{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]
    return attach(df, med).select(*out)


def describe(df: DataFrame, col: str) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum."""
    q = exact_quantiles(df, {"q25": (col, 0.25), "q50": (col, 0.5), "q75": (col, 0.75)})
    one = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
                 F.min(col).alias("min"), F.max(col).alias("max"))
    return attach(one, q).select("*", "_s.*").drop("_s")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed on the right. Empty bins are not listed."""
    ends = df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi"))
    lo, hi = F.col("_s.lo"), F.col("_s.hi")
    width = (hi - lo) / F.lit(float(bins))
    pos = F.when(hi == lo, F.lit(0)).otherwise(F.floor((F.col(col) - lo) / F.nullif(width, F.lit(0.0))))
    return (attach(df.where(F.col(col).isNotNull()), ends)
            .select(F.least(pos, F.lit(bins - 1)).cast("long").alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


def box_stats(df: DataFrame, col: str, by: str, groups: list) -> DataFrame:
    """Five-number summary per value of a flag; the few values are given."""
    marks = {"min": 0.0, "q25": 0.25, "q50": 0.5, "q75": 0.75, "max": 1.0}
    split = df.select(*[F.when(F.col(by) == g, F.col(col)).alias(f"c{i}") for i, g in enumerate(groups)])
    q = exact_quantiles(split, {f"{m}_{i}": (f"c{i}", p) for i in range(len(groups)) for m, p in marks.items()})
    cells = F.array(*[F.struct(F.lit(g).alias(by), *[F.col(f"{m}_{i}").alias(m) for m in marks]) for i, g in enumerate(groups)])
    return q.select(F.explode(cells).alias("c")).select("c.*")
