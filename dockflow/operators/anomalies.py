"""Outlier rules, outlier models on samples, spectra and denoising."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dockflow.operators.nearest import build, neighbourhoods
from dockflow.operators.quantiles import attach, exact_quantiles, fill_median, scalar_struct
from dockflow.operators.ranking import in_share, sample_fraction
from dockflow.session import stage


def daily_anomalies(daily: DataFrame, k: float = 2.0, value: str = "trip_count") -> DataFrame:
    """Days whose z-score (n - 1) over the result exceeds k in size."""
    m = daily.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    z = (F.col(value) - F.col("_s.mean")) / F.nullif(F.col("_s.std"), F.lit(0.0))
    return attach(daily, m).withColumn("z_score", z).drop("_s").where(F.abs("z_score") > k)


def iqr_flag(df: DataFrame, col: str, k: float = 4.0, name: str = "iqr_outlier", source: DataFrame | None = None) -> DataFrame:
    """1 outside the quartiles by more than k interquartile ranges; ``source`` is the table the quartiles come from."""
    q = exact_quantiles(df if source is None else source, {"q1": (col, 0.25), "q3": (col, 0.75)})
    q1, q3 = F.col("_s.q1"), F.col("_s.q3")
    out = (F.col(col) < q1 - k * (q3 - q1)) | (F.col(col) > q3 + k * (q3 - q1))
    return attach(df, q).withColumn(name, F.when(out, 1).otherwise(0)).drop("_s")


def zscore_flag(df: DataFrame, col: str, k: float = 4.0, name: str = "z_outlier", source: DataFrame | None = None) -> DataFrame:
    """1 where the z-score with the population deviation exceeds k; nulls count as the median."""
    base = (df if source is None else source).select(F.col(col).cast("double").alias("v"))
    med = exact_quantiles(base, {"med": ("v", 0.5)})
    # mean and deviation with the nulls at the median, from the sums of the present values: no second filled pass
    n, present, s1, s2 = F.count(F.lit(1)), F.count("v"), F.avg("v"), F.var_pop("v")
    one = attach(base.agg(n.alias("n"), present.alias("p"), s1.alias("a"), s2.alias("b")), med)
    share = F.col("p") / F.col("n")
    mean = F.col("a") * share + F.col("_s.med") * (1 - share)
    var = share * (F.col("b") + F.pow(F.col("a") - mean, F.lit(2))) + (1 - share) * F.pow(F.col("_s.med") - mean, F.lit(2))
    stats = one.select(mean.alias("mean"), F.sqrt(var).alias("std"), F.col("_s.med").alias("med"))
    z = F.abs((F.coalesce(F.col(col).cast("double"), F.col("_s.med")) - F.col("_s.mean")) / F.nullif(F.col("_s.std"), F.lit(0.0)))
    return attach(df, stats).withColumn(name, F.when(z > k, 1).otherwise(0)).drop("_s")


def mad_flag(df: DataFrame, col: str, k: float = 6.0, name: str = "mad_outlier", source: DataFrame | None = None) -> DataFrame:
    """1 where the distance from the median exceeds k scaled median absolute deviations."""
    base = (df if source is None else source).select(F.col(col).cast("double").alias("v"))
    med = exact_quantiles(base, {"med": ("v", 0.5)})
    dev = attach(base, med).select(F.abs(F.col("v") - F.col("_s.med")).alias("d"))
    stats = attach(exact_quantiles(dev, {"mad": ("d", 0.5)}), med).select("mad", F.col("_s.med").alias("med"))
    out = F.abs(F.col(col) - F.col("_s.med")) > F.lit(k * 1.4826) * F.col("_s.mad")
    return attach(df, stats).withColumn(name, F.when(out, 1).otherwise(0)).drop("_s")


def rule_flags(df: DataFrame, col: str, iqr: float = 4.0, z: float = 4.0, mad: float | None = 6.0) -> DataFrame:
    """The flags of ``iqr_flag``, ``zscore_flag`` and, unless ``mad`` is None, ``mad_flag`` together: quartiles and median come from one call."""
    base = df.select(F.col(col).cast("double").alias("v"))
    q = exact_quantiles(base, {"q1": ("v", 0.25), "med": ("v", 0.5), "q3": ("v", 0.75)})
    med = F.col("_s.med")
    filled = attach(base, q).select(F.coalesce("v", med).alias("f"))
    stats = attach(filled.agg(F.avg("f").alias("mean"), F.stddev_pop("f").alias("std")), q, "_q").select("mean", "std", "_q.*")
    if mad is not None:
        away = exact_quantiles(attach(base, q).select(F.abs(F.col("v") - med).alias("d")), {"mad": ("d", 0.5)})
        stats = attach(stats, away, "_a").select("mean", "std", "q1", "med", "q3", "_a.mad")
    v, s = F.col(col).cast("double"), lambda name: F.col(f"_s.{name}")
    spread = s("q3") - s("q1")
    flags = {"iqr_outlier": (v < s("q1") - iqr * spread) | (v > s("q3") + iqr * spread),
             "z_outlier": F.abs((F.coalesce(v, s("med")) - s("mean")) / F.nullif(s("std"), F.lit(0.0))) > z}
    if mad is not None:
        flags["mad_outlier"] = F.abs(v - s("med")) > F.lit(mad * 1.4826) * s("mad")
    return attach(df, stats).withColumns({n: F.when(f, 1).otherwise(0) for n, f in flags.items()}).drop("_s")


def four_votes(df: DataFrame, col: str, key: list[str], cols: list[str], share: float = 1.0, least: int = 2, trees: int = 50) -> DataFrame:
    """The rows with the flags of quartiles, z-score, isolation forest and local outlier factor, and whether ``least`` of them agree.

    All four cover every row; a ``share`` below 1 limits the factors to the rows of that share. Forest and factors depend on a row's values
    alone, so equal rows are folded into one place with their number as weight and scored once; the edges are those of ``isolation_forest`` and ``local_outlier_factor``, over the rows.
    Only the flagged places are joined with the wide table, by their values: they are staged, so their size is known before it would be
    shuffled. ``df`` is read several times and should be staged.
    """
    median = exact_quantiles(df, {c: (c, 0.5) for c in cols})
    at = F.array(*[F.coalesce(F.col(c).cast("double"), F.col(f"_m.{c}")) for c in cols])
    rows = attach(rule_flags(df, col, mad=None), median, "_m").withColumn("_x", at).drop("_m")
    filled = [f"_{c}" for c in cols]
    score = forest_score(rows.select(*key, *[F.get("_x", F.lit(i)).alias(c) for i, c in enumerate(filled)]), key, filled, trees)
    places = rows.groupBy(F.col("_x").alias("x")).agg(F.count_if(in_share(key, share)).alias("w")).withColumn("p", F.monotonically_increasing_id())
    places = stage(places, "vote-places")
    scores = places.join(place_factors(places.where("w > 0"), len(cols)), "p", "left")
    scores = stage(scores.select(F.col("x").alias("_x"), score(*[F.get("x", F.lit(i)) for i in range(len(cols))]).alias("iso"), "lof"), "vote-scores")
    each = rows.select("_x", in_share(key, share).alias("_in")).join(scores, "_x").select("iso", F.when(F.col("_in"), F.col("lof")).alias("lof"))
    edge = each.agg(F.percentile_approx("iso", 0.95, 10_000).alias("iso")).crossJoin(exact_quantiles(each, {"lof": ("lof", 0.95)}))
    edges = attach(scores, edge)
    flags = edges.select("_x", *[F.coalesce(F.col(c) > F.col(f"_s.{c}"), F.lit(False)).cast("int").alias(f"{c}_outlier") for c in ("iso", "lof")])
    odd = stage(flags.where("iso_outlier + lof_outlier > 0"), "vote-outliers")
    voted = rows.join(odd, "_x", "left").withColumns({"iso_outlier": F.coalesce("iso_outlier", F.lit(0)), "lof_outlier": F.when(in_share(key, share), F.coalesce("lof_outlier", F.lit(0))).otherwise(0)})
    return consensus(voted.select(*df.columns, "iqr_outlier", "z_outlier", "iso_outlier", "lof_outlier"), ["iqr_outlier", "z_outlier", "iso_outlier", "lof_outlier"], least)


def consensus(df: DataFrame, flags: list[str], least: int = 2) -> DataFrame:
    """Outlier when at least ``least`` of the methods agree."""
    votes = sum((F.col(f) for f in flags[1:]), F.col(flags[0]))
    return df.withColumn("is_outlier", F.when(votes >= least, 1).otherwise(0))


def remove_outliers(df: DataFrame, flag: str = "is_outlier") -> DataFrame:
    return df.where(F.col(flag) == 0)


def cap_outliers(df: DataFrame, col: str, flag: str = "is_outlier", low: float = 0.01, high: float = 0.99, source: DataFrame | None = None) -> DataFrame:
    """Outliers are limited to the outer quantiles instead of removed."""
    q = exact_quantiles(df if source is None else source, {"lo": (col, low), "hi": (col, high)})
    v = F.col(col).cast("double")
    capped = F.greatest(F.col("_s.lo"), F.least(F.col("_s.hi"), v))
    return attach(df, q).withColumn(col, F.when(F.col(flag) == 1, capped).otherwise(v)).drop("_s")


# ---------------------------------------------------------------------------------------------------------------------
# isolation forest

def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, nodes: list) -> int:
    """Add the isolation subtree of the rows to ``nodes`` as (feature, threshold, left, right, size, depth)."""
    at = len(nodes)
    nodes.append(None)
    low, high = (x.min(axis=0), x.max(axis=0)) if len(x) else (np.zeros(0), np.zeros(0))
    usable = np.flatnonzero(high > low)
    if len(x) <= 1 or depth >= limit or len(usable) == 0:
        nodes[at] = (-1, 0.0, -1, -1, len(x), depth)
        return at
    f = int(rng.choice(usable))
    cut = float(rng.uniform(low[f], high[f]))
    below = x[:, f] < cut
    left = _grow(x[below], rng, depth + 1, limit, nodes)
    right = _grow(x[~below], rng, depth + 1, limit, nodes)
    nodes[at] = (f, cut, left, right, len(x), depth)
    return at


def _average_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


def _table(nodes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """A tree for scoring: feature and cut of each node, the nodes after it (right, left), path lengths, depth. A leaf is followed by itself."""
    leaf = nodes["feature"].to_numpy() < 0
    own = np.arange(len(nodes))
    after = np.column_stack([np.where(leaf, own, nodes["right"]), np.where(leaf, own, nodes["left"])]).ravel().astype(np.intp)
    feature = np.where(leaf, 0, nodes["feature"]).astype(np.intp)
    return feature, nodes["cut"].to_numpy(float), after, nodes["depth"].to_numpy() + _average_path(nodes["size"].to_numpy()), int(nodes["depth"].max())


def forest_score(x: DataFrame, key: list[str], cols: list[str], trees: int = 50, subsample: int = 256, seed: int = 42):
    """A column function of ``cols`` (without nulls): the isolation score. Trees are grown on small samples, one group per tree.

    Group size is a parameter of the method (``subsample``), the tree table has at most trees x 2 x subsample rows and is
    shipped to the scoring tasks as a broadcast variable.
    """
    n = x.count()
    # a pool of about trees * subsample rows by hash, from which every tree draws its own share
    pool = trees * subsample
    rows = sample_fraction(x, key, pool / max(n, 1), seed).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    rows = sample_fraction(rows, ["tree", *key], 1.5 * subsample / max(min(n, pool), 1), seed + 1)
    picked = rows.select("tree", F.xxhash64(F.lit(seed + 2), "tree", *key).alias("order"), *cols)
    w = Window.partitionBy("tree").orderBy("order")
    picked = picked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= subsample).drop("rn", "order")
    limit = math.ceil(math.log2(max(subsample, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        nodes: list = []
        _grow(pdf[cols].to_numpy(float), np.random.default_rng(seed + tree), 0, limit, nodes)
        out = pd.DataFrame(nodes, columns=["feature", "cut", "left", "right", "size", "depth"])
        out.insert(0, "node", range(len(out)))
        out.insert(0, "tree", tree)
        return out

    table = picked.groupBy("tree").applyInPandas(
        grow, "tree int, node int, feature int, cut double, left int, right int, size long, depth int")
    forest = [g.sort_values("node") for _, g in table.toPandas().groupby("tree")]  # bounded: trees x 2 x subsample rows
    packed = x.sparkSession.sparkContext.broadcast([_table(g) for g in forest])
    norm = float(np.mean([_average_path(np.array([g["size"].iloc[0]]))[0] for g in forest])) or 1.0

    @F.pandas_udf("double")
    def score(*series: pd.Series) -> pd.Series:
        m = np.column_stack([s.to_numpy(float) for s in series])
        total = np.zeros(len(m))
        flat, first = m.ravel(), np.arange(len(m)) * m.shape[1]
        for feature, cut, after, length, depth in packed.value:
            at = np.zeros(len(m), dtype=np.intp)
            for _ in range(depth):
                at = after[2 * at + (flat[first + feature[at]] < cut[at])]
            total += length[at]
        return pd.Series(np.power(2.0, -total / max(len(packed.value), 1) / norm))

    return score


def isolation_forest(df: DataFrame, key: list[str], cols: list[str], trees: int = 50, subsample: int = 256,
                     contamination: float = 0.05, seed: int = 42, carry: list[str] | None = None) -> DataFrame:
    """Isolation score and flag of every row, with its key and the columns in ``carry``. The threshold is the score quantile of the contamination."""
    filled = [f"_{c}" for c in cols]
    x = fill_median(df.select(*dict.fromkeys([*key, *(carry or [])]), *[F.col(c).cast("double").alias(f) for c, f in zip(cols, filled)]), filled)
    score = forest_score(x, key, filled, trees, subsample, seed)
    scored = stage(x.select(*[c for c in x.columns if c not in filled], score(*filled).alias("iso_score")), "isolation-scores")
    edge = scored.agg(F.percentile_approx("iso_score", 1 - contamination, 10_000)).scalar()
    return scored.withColumn("iso_outlier", F.when(F.col("iso_score") > edge, 1).otherwise(0))


# ---------------------------------------------------------------------------------------------------------------------
# local outlier factor

def place_factors(places: DataFrame, dims: int, k: int = 20) -> DataFrame:
    """(p, lof) of each place (p, x, w): its local outlier factor, as a row among all rows, of which ``w`` are at a place.

    Each place is compared with the few boxes of an adaptive tree around it.
    """
    near = stage(neighbourhoods(places.select(F.col("p").alias("q"), "x"), build(places, dims), k + 1), "lof-near")
    others = near.withColumn("w", F.when(F.col("q") == F.col("p"), F.col("w") - 1).otherwise(F.col("w")))  # a row isn't its own neighbour
    reach = near.groupBy(F.col("q").alias("p")).agg(F.sqrt(F.max("d2")).alias("reach"))
    mean = F.sum(F.col("w") * F.greatest(F.sqrt("d2"), F.col("reach"))) / F.nullif(F.sum("w"), F.lit(0))
    dense = stage(others.join(reach, "p").groupBy("q").agg((1 / (mean + 1e-10)).alias("density")), "lof-density")
    around = others.join(dense.withColumnRenamed("q", "p"), "p").groupBy("q").agg((F.sum(F.col("w") * F.col("density")) / F.nullif(F.sum("w"), F.lit(0))).alias("around"))
    return around.join(dense, "q").select(F.col("q").alias("p"), F.round(F.col("around") / F.col("density"), 9).alias("lof"))


def local_outlier_factor(df: DataFrame, key: list[str], cols: list[str], k: int = 20, share: float = 1.0, contamination: float = 0.05) -> DataFrame:
    """Local outlier factor among a share of the rows, chosen by a digest of the key; of these the highest scores are flagged, the rest is normal.

    Neighbours are the other rows of the share within the distance of the k-th nearest one, ties included, so the factor doesn't depend
    on any order. They are found by a join through an adaptive tree: rows at one place are folded into one with their number as weight,
    and each place is compared with the few boxes around it. ``share`` 1 scores every row. Nulls count as the median of the share.
    (key, lof, lof_outlier); lof is null outside the share and where there is no other row.
    """
    chosen = fill_median(stage(df.where(in_share(key, share)).select(*key, *[F.col(c).cast("double").alias(c) for c in cols]), "lof-share"), cols)
    places = stage(chosen.groupBy(F.array(*cols).alias("x")).agg(F.count("*").alias("w")).withColumn("p", F.monotonically_increasing_id()), "lof-places")
    score = place_factors(places, len(cols), k)
    scored = stage(chosen.withColumn("x", F.array(*cols)).join(places.select("x", "p"), "x").join(score, "p", "left").select(*key, "lof"), "lof-scores")
    flagged = attach(scored, exact_quantiles(scored, {"edge": ("lof", 1 - contamination)})).withColumn("lof_outlier", F.when(F.col("lof") > F.col("_s.edge"), 1).otherwise(0)).drop("_s")
    return df.select(*key).join(flagged, key, "left").select(*key, "lof", F.coalesce("lof_outlier", F.lit(0)).alias("lof_outlier"))


# ---------------------------------------------------------------------------------------------------------------------
# spectra and denoising

def dominant_periods(series: DataFrame, col: str = "pickups", k: int = 3, least: int = 168, key: str = "station_name", time: str = "time") -> DataFrame:
    """The k strongest positive frequencies (cycles per hour) of every station's hourly series, constant part left out.

    Takes the sparse series: a station sends only its hours with demand to its task, at most one row per hour of the
    covered period, and the transform runs there. ``rank`` 1 is the strongest.
    """
    ends = scalar_struct(series.agg(F.min(time).alias("lo"), F.max(time).alias("hi")))
    lo = ends.getField("lo")
    hours = F.timestamp_diff("HOUR", lo, ends.getField("hi")) + 1
    rows = series.where(F.col(col) != 0).select(key, F.timestamp_diff("HOUR", lo, F.col(time)).cast("int").alias("t"),
                                                F.col(col).cast("double").alias("x"), hours.cast("int").alias("n"))

    def spectrum(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        if n <= least:
            return pd.DataFrame({key: [], "rank": [], "freq": [], "power": []})
        x = np.zeros(n)
        x[pdf["t"].to_numpy()] = pdf["x"].to_numpy()
        power = np.abs(np.fft.rfft(x)) ** 2
        power[0] = -1.0
        top = np.lexsort((np.arange(len(power)), -np.round(power, 6)))[:k]
        top = top[power[top] >= 0]
        return pd.DataFrame({key: pdf[key].iloc[0], "rank": np.arange(1, len(top) + 1), "freq": top / n, "power": power[top]})

    kind = dict(series.dtypes)[key]
    return rows.groupBy(key).applyInPandas(spectrum, f"{key} {kind}, rank int, freq double, power double")


def periodogram(series: DataFrame, periods: list[float], col: str = "pickups", key: str = "station_name", time: str = "time") -> DataFrame:
    """Power of chosen periods (hours) per station as plain sums, for long series where a few periods are of interest.

    Partial sums in every task make it one aggregate; hours without demand add nothing and need no rows.
    """
    lo = series.agg(F.min(time)).scalar()
    base = series.select(key, F.col(col).cast("double").alias("x"), F.timestamp_diff("HOUR", lo, F.col(time)).cast("double").alias("t"))
    aggs = []
    for i, p in enumerate(periods):
        angle = F.lit(2 * math.pi / p) * F.col("t")
        aggs += [F.sum(F.col("x") * F.cos(angle)).alias(f"c{i}"), F.sum(F.col("x") * F.sin(angle)).alias(f"s{i}")]
    sums = base.groupBy(key).agg(*aggs)
    cells = F.array(*[F.struct(F.lit(float(p)).alias("period"), (F.pow(f"c{i}", F.lit(2)) + F.pow(f"s{i}", F.lit(2))).alias("power"))
                      for i, p in enumerate(periods)])
    return sums.select(key, F.explode(cells).alias("c")).select(key, "c.*")


def denoise(df: DataFrame, col: str, levels: int = 3, least: int = 100, key: str = "station_name", time: str = "time", out: str | None = None) -> DataFrame:
    """Soft-threshold denoising with a shift-invariant Haar transform, per station.

    Level j averages a value with the one 2^(j-1) rows back (the first value repeats before the start); the details are
    shrunk by the universal threshold and added back. Stations with fewer than ``least`` rows stay as they are. The
    windows share one partitioning by station; the median of the details is over one station's rows.
    """
    w = Window.partitionBy(key).orderBy(time)
    whole = Window.partitionBy(key)
    keep = df.columns
    rows = df.withColumn("_a0", F.col(col).cast("double")).withColumn("_n", F.count(F.lit(1)).over(whole))
    for j in range(1, levels + 1):
        prev, cur = f"_a{j - 1}", f"_a{j}"
        back = F.coalesce(F.lag(prev, 2 ** (j - 1)).over(w), F.first(prev).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.withColumn(cur, (F.col(prev) + back) / 2)
    detail = lambda j: F.col(f"_a{j - 1}") - F.col(f"_a{j}")
    rows = rows.withColumn("_mad", F.percentile(F.abs(detail(1)), 0.5).over(whole))
    threshold = F.col("_mad") / F.lit(0.6745) * F.sqrt(F.lit(2.0) * F.log(F.col("_n").cast("double")))
    value = F.col(f"_a{levels}")
    for j in range(levels, 0, -1):
        d = detail(j)
        value = value + F.signum(d) * F.greatest(F.abs(d) - threshold, F.lit(0.0))
    return rows.select(*keep, F.when(F.col("_n") < least, F.col("_a0")).otherwise(value).alias(out or f"{col}_denoised"))
