"""Embedding whitening by spectrum slicing.

The covariance of the distinct integer vectors is summed by Spark. Its leading eigenvalues are found one by one: the factorisation
L D L' of the covariance less a shift has as many positive pivots as there are eigenvalues above the shift, so counts at few shifts cut
the spectrum into slices with one eigenvalue each. In its slice Rayleigh quotient iteration converges cubically, and two counts beside
the result certify that it is the k-th. Eigenvalues closer than rounding stay one slice; their vectors are kept orthogonal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dockflow.llm.shared import stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
LARGEST = 2.0**60  # an entry whose integer is not below this has no place among long numbers
EPS = np.finfo(float).eps
MERGE_TASKS = 64  # tasks that partial matrices of all tasks are added up in before the driver adds theirs

# --- factorisation and slicing of a symmetric matrix --------------------------------------------------------------------------------


@dataclass
class Factors:
    """P A P' = L D L': ``order`` is the permutation, ``lower`` the unit lower factor, ``blocks`` the (start, block) of D."""

    order: np.ndarray
    lower: np.ndarray
    blocks: list[tuple[int, np.ndarray]]

    def above(self) -> int:
        """Number of positive eigenvalues, by Sylvester's law of inertia that of D's."""
        n = 0
        for _, d in self.blocks:
            n += int(d[0, 0] > 0) if len(d) == 1 else (1 if np.linalg.det(d) < 0 else 2 * int(d[0, 0] + d[1, 1] > 0))
        return n

    def solve(self, b: np.ndarray, least: float) -> np.ndarray:
        """The solution; pivots smaller than ``least`` count as that, so a shift that is an eigenvalue still gives its vector."""
        x = b[self.order].astype(float)
        for k in range(len(x)):
            x[k + 1:] -= self.lower[k + 1:, k] * x[k]
        for k, d in self.blocks:
            if len(d) == 1:
                p = d[0, 0]
                x[k] /= p if abs(p) >= least else least
            else:
                x[k:k + 2] = np.linalg.solve(d, x[k:k + 2])
        for k in range(len(x) - 1, -1, -1):
            x[k] -= self.lower[k + 1:, k] @ x[k + 1:]
        out = np.empty_like(x)
        out[self.order] = x
        return out


def factor(matrix: np.ndarray) -> Factors:
    """Symmetric factorisation with pivots of one or two rows, chosen so that no element grows without bound."""
    a, n, k, alpha = matrix.astype(float), len(matrix), 0, (1 + 17**0.5) / 8
    order, blocks = np.arange(n), []

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            order[[i, j]] = order[[j, i]]

    lower = np.eye(n)
    while k < n:
        size = 1
        column = np.abs(a[k + 1:, k])
        if len(column) and column.max() > 0 and abs(a[k, k]) < alpha * column.max():
            r, largest = k + 1 + int(column.argmax()), column.max()
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if abs(a[k, k]) * row.max() < alpha * largest**2:
                if abs(a[r, r]) >= alpha * row.max():
                    swap(k, r)
                    lower[[k, r], :k] = lower[[r, k], :k]
                else:
                    size = 2
                    swap(k + 1, r)
                    lower[[k + 1, r], :k] = lower[[r, k + 1], :k]
        d, below = a[k:k + size, k:k + size].copy(), a[k + size:, k:k + size]
        if size == 2 or d[0, 0] != 0:
            part = below / d[0, 0] if size == 1 else np.linalg.solve(d, below.T).T
            a[k + size:, k + size:] -= part @ below.T
            lower[k + size:, k:k + size] = part
        blocks.append((k, d))
        k += size
    return Factors(order, lower, blocks)


@dataclass
class Slicer:
    """The leading eigenpairs of a symmetric matrix, by counts."""

    matrix: np.ndarray

    def __post_init__(self):
        self.n = len(self.matrix)
        self.norm = float(np.abs(self.matrix).sum(axis=1).max(initial=0.0))
        self.tiny = 4 * EPS * self.norm * max(1, self.n) ** 0.5
        self.known: dict[float, int] = {self.norm * 1.01 + self.tiny: 0, -self.norm * 1.01 - self.tiny: self.n}

    def above(self, shift: float) -> int:
        """Number of eigenvalues above a shift."""
        if shift not in self.known:
            self.known[shift] = factor(self.matrix - shift * np.eye(self.n)).above()
        return self.known[shift]

    def slice_of(self, k: int) -> tuple[float, float]:
        """(low, high): the k-th eigenvalue lies between, alone or with others that are closer than rounding."""
        high, low = min(s for s, c in self.known.items() if c < k), max(s for s, c in self.known.items() if c >= k)
        while (self.known[high], self.known[low]) != (k - 1, k) and high - low > 2 * self.tiny:
            high, low = self.halved(k, high, low)
        return low, high

    def halved(self, k: int, high: float, low: float) -> tuple[float, float]:
        middle = (low + high) / 2
        return (middle, low) if self.above(middle) < k else (high, middle)

    def pair(self, k: int, others: list[np.ndarray]) -> tuple[float, np.ndarray]:
        """The k-th eigenvalue and its unit vector, orthogonal to ``others``."""
        low, high = self.slice_of(k)
        seed = np.random.default_rng([self.n, k]).standard_normal(self.n)
        while True:
            v, value = self.polish(self.apart(seed, others), (low + high) / 2, low, high, others)
            if v is not None and self.certified(k, value, low, high):
                return value, v
            if high - low <= 2 * self.tiny:  # no narrower slice is told apart by rounded counts
                return (value, v) if v is not None else ((low + high) / 2, self.apart(seed, others))
            high, low = self.halved(k, high, low)

    def polish(self, v: np.ndarray, shift: float, low: float, high: float, others: list[np.ndarray]):
        """Two steps of inverse iteration from the slice's middle, then Rayleigh quotients as shifts till the residual is rounding."""
        best = (np.inf, None, shift)
        for step in range(12):
            v = self.apart(factor(self.matrix - shift * np.eye(self.n)).solve(v, self.tiny + np.finfo(float).tiny), others)
            value = float(v @ self.matrix @ v)
            rest = float(np.linalg.norm(self.matrix @ v - value * v))
            if not low - self.tiny <= value <= high + self.tiny:
                return None, shift
            if rest >= best[0] and step > 3:
                break
            best = min(best, (rest, v, value), key=lambda x: x[0])
            shift = value if step else shift
        return best[1], best[2]

    def certified(self, k: int, value: float, low: float, high: float) -> bool:
        """Counts just beside the value number it: fewer than k eigenvalues above, k or more from below it."""
        return self.above(value + 8 * self.tiny) < k <= self.above(value - 8 * self.tiny)

    @staticmethod
    def apart(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            for o in others:
                v = v - (o @ v) * o
            v = v / (np.linalg.norm(v) or 1.0)
        return v


def leading(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the ``count`` largest, falling. The largest entry of a vector is positive."""
    if not matrix.any():
        return np.zeros(min(count, len(matrix))), np.eye(len(matrix), min(count, len(matrix)))
    s, values, vectors = Slicer((matrix + matrix.T) / 2), [], []
    for k in range(1, min(count, len(matrix)) + 1):
        value, v = s.pair(k, vectors)
        values.append(value)
        vectors.append(v * (1.0 if v[np.abs(v).argmax()] >= 0 else -1.0))
    at = sorted(range(len(values)), key=lambda i: (-values[i], i))
    return np.array([values[i] for i in at]), np.array([vectors[i] for i in at]).T.reshape(len(matrix), len(values))


# --- vectors and sums -----------------------------------------------------------------------------------------------------------------


def integers(table: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, dim, x) of the usable rows: floor(SCALE * entry) + SHIFT of all entries, as bytes of 32-bit integers if all fit, else of 64-bit ones.

    A row whose vector is null, or holds null or non-finite entries, or entries beyond long integers, is left out; so is one without entries.
    """
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            lists = b.column(1)
            size = np.array([0 if x is None else x for x in pc.list_value_length(lists).to_pylist()], np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # nulls become nan
            row = np.repeat(np.arange(len(size)), size)
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(SCALE * flat)
                bad = ~(np.abs(scaled) < LARGEST)
            good = (size > 0) & (np.bincount(row[bad], minlength=len(size)) == 0)
            start = np.cumsum(size) - size
            out = []
            for k in np.flatnonzero(good):
                x = scaled[start[k]:start[k] + size[k]].astype(np.int64) + SHIFT
                out.append(x.astype("<i4").tobytes() if -(1 << 31) <= x.min() and x.max() < 1 << 31 else x.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(good)), pa.array(size[good].astype(np.int32)), pa.array(out, pa.binary())], names=["vec_id", "dim", "x"])

    return table.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, f"vec_id {kind}, dim int, x binary")


def _matrices(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, rows of the batch, their integer vectors as a matrix) for each number of entries and kind of integers."""
    dims, xs = b.column("dim").to_numpy(), b.column("x").to_pylist()
    wide = np.array([len(x) for x in xs], np.int64) > 4 * dims
    for d in np.unique(dims):
        for kind in (False, True):
            rows = np.flatnonzero((dims == d) & (wide == kind))
            if len(rows):
                yield int(d), rows, np.frombuffer(b"".join(xs[i] for i in rows), "<i8" if kind else "<i4").reshape(len(rows), d).astype(np.int64)


def _added(frame: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], dict[int, np.ndarray]], dtype: str = "<f8") -> dict[int, np.ndarray]:
    """Sums over all tasks of the vector that ``fn`` makes for each number of entries; first in MERGE_TASKS tasks, then here."""
    def run(batches: Iterator[pa.RecordBatch]):
        made = fn(batches)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(made), pa.int32()), "v": pa.array([v.tobytes() for v in made.values()], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total[d] = total.get(d, 0) + np.frombuffer(v, dtype)
        yield pa.RecordBatch.from_pydict({"dim": pa.array(list(total), pa.int32()), "v": pa.array([v.tobytes() for v in total.values()], pa.binary())})

    parts = frame.mapInArrow(run, "dim int, v binary")
    if frame.sparkSession.sparkContext.defaultParallelism > MERGE_TASKS:
        parts = parts.repartition(MERGE_TASKS, F.spark_partition_id()).mapInArrow(merge, "dim int, v binary")
    total: dict[int, np.ndarray] = {}
    for r in parts.collect():
        total[r.dim] = total.get(r.dim, 0) + np.frombuffer(r.v, dtype)
    return total


@dataclass
class Model:
    """Of the vectors of one length: their number and sums in whole numbers, and the components. ``scale``: 1 / root of e, 0 where e is 0."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    scale: np.ndarray
    explained: np.ndarray
    error: float = 0.0

    def __post_init__(self):
        self.floor = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = [s - self.n * int(q) for s, q in zip(self.sums, self.floor)]

    def times(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: in 64-bit integers where they surely hold it and its squares' sum, else in Python's."""
        y = x - self.floor
        if self.n * (float(np.abs(y).max(initial=0)) + 1.0) < 2.0**31 / max(1, len(self.sums)) ** 0.5:
            return self.n * y - np.array(self.rest, np.int64)
        return self.n * y.astype(object) - np.array(self.rest, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.times(x) / self.n).astype(float)


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each length of vectors among ``distinct`` (dim, x): three passes, each of which sends a sum of fixed size a task."""
    def sums(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _matrices(b):
                high = x >> 31  # high and low halves add up without overflow
                out[d] = out.get(d, 0) + np.concatenate([[len(x)], high.sum(axis=0), (x - (high << 31)).sum(axis=0)])
        return out

    models = {}
    for d, t in _added(distinct, sums, "<i8").items():
        s = [(int(h) << 31) + int(lo) for h, lo in zip(t[1:d + 1], t[d + 1:])]
        models[d] = Model(int(t[0]), s, np.zeros(0), np.zeros((d, 0)), np.zeros(0), np.zeros(0))
    share = distinct.sparkSession.sparkContext.broadcast(models)

    def products(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _matrices(b):
                z = share.value[d].centred(x)
                out[d] = out.get(d, 0) + np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])
        return out

    means = {}
    for d, t in _added(distinct, products).items():
        m = models[d]
        v = t[d:].reshape(d, d) / m.n
        trace = float(np.trace(v))
        values, vectors = leading(v, components)
        real = values > 64 * EPS * d * trace  # what is left of a zero is rounding
        m.values, m.vectors, m.scale = values, vectors, np.where(real, 1 / np.sqrt(np.where(real, values, 1.0)), 0.0)
        m.explained = np.where(real, values, 0.0) / (trace or 1.0)
        means[d] = (t[:d] / m.n) @ vectors * m.scale
    fitted = distinct.sparkSession.sparkContext.broadcast((models, means))

    def whitened(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _matrices(b):
                m = fitted.value[0][d]
                w = m.centred(x) @ m.vectors * m.scale - fitted.value[1][d]
                out[d] = out.get(d, 0) + (w.T @ w).ravel()
        return out

    for d, t in _added(distinct, whitened).items():
        m, k = models[d], len(models[d].values)
        off = np.abs(t.reshape(k, k) / m.n - np.eye(k))[np.ix_(m.scale > 0, m.scale > 0)]
        m.error = float(off.max(initial=0.0))
    return models


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component.

    Rows with a null vector, null or non-finite entries are left out, as are entries beyond long integers and empty vectors. Repeated rows
    and rows without a key are each whitened, but count once in the fit. Vectors of different lengths have a fit of their own each. A
    component without variance (a table of one distinct vector, dependent entries) has whitened null and explains 0; the error is of
    the others. A deviation beyond long integers is null. Equal eigenvalues: any orthonormal vectors, the same for all rows. Other
    columns are left out; an empty table gives no rows.
    """
    x = stage(integers(table, key, vector), "whitening-integers")
    models = fit(stage(x.select("dim", "x").distinct(), "whitening-fit"), components)
    share = table.sparkSession.sparkContext.broadcast(models)
    kind = table.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for d, rows, x in _matrices(b):
                m = share.value[d]
                k, times = len(m.values), m.times(x)
                squares = [int(s) for s in (times * times).sum(axis=1)]
                w = (m.centred(x) @ m.vectors * m.scale).ravel()
                at = pa.array(np.repeat(rows, k))
                yield pa.RecordBatch.from_arrays([
                    b.column("vec_id").take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(w), m.n, np.int64)),
                    pa.array([s if s < 1 << 63 else None for s in squares], pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k))),
                    pa.array(w, mask=np.tile(m.scale == 0, len(rows))), pa.array(np.tile(m.explained, len(rows))), pa.array(np.full(len(w), m.error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    out = x.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("vec_id", key)
