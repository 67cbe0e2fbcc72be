"""Whitening against numpy's eigenvectors and exact whole numbers."""

import numpy as np
import pytest

from dockflow.llm import whitening
from dockflow.llm.queries import QUERIES
from dockflow.llm.shared import table

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, n string, component string"


def expected(vectors):
    """(integers, n, sums, eigenvalues, eigenvectors) by brute force."""
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    e, v = np.linalg.eigh(z.T @ z / n)
    return x, n, s, e[::-1], v[:, ::-1]


def test_query_by_force(spark):
    rows = {r.vec_id: list(r.embedding) for r in table(spark, SMALL, "embeddings").collect() if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)}
    got = QUERIES["op11_spectrum_whitening"](spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    ids = sorted(rows)
    x, n, s, e, v = expected([rows[i] for i in ids])
    assert got.vec_id.tolist() == [i for i in ids for _ in range(16)] and (got.n == n).all()
    assert got.deviation.tolist() == np.repeat(((n * x - s) ** 2).sum(axis=1), 16).tolist()
    want = (x - s / n) @ v[:, :16] / np.sqrt(e[:16])
    have = got.whitened.to_numpy().reshape(-1, 16)
    assert np.abs(have * np.sign((have * want).sum(axis=0)) - want).max() < 1e-8
    assert np.allclose(got.explained.to_numpy()[:16], e[:16] / e.sum(), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10


@pytest.mark.parametrize("values", [[5.0, 5, 5, 1, 1, 0], [3.0] * 7, [1.0, 1 + 1e-13, 1 - 1e-13, 0.5], [1e12, 1.0, 1e-3], [2.0], [9.0, 8, 7, 6, 5, 4, 3, 2, 1] * 3])
def test_slices(values):
    """Known spectra, simple, repeated and closer than rounding, in a turned basis."""
    d = len(values)
    turn = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    m = turn @ np.diag(values) @ turn.T
    e, v = whitening.leading(m, 16)
    assert np.allclose(e, sorted(values, reverse=True)[:16], rtol=1e-12, atol=1e-12 * max(values))
    assert np.abs(v.T @ v - np.eye(len(e))).max() < 1e-12 and np.abs(m @ v - v * e).max() < 1e-11 * max(values)


def test_counts():
    m = np.random.default_rng(0).standard_normal((30, 30))
    m = m + m.T  # indefinite: pivots of two rows
    e = np.linalg.eigvalsh(m)
    for shift in np.linspace(e[0] - 1, e[-1] + 1, 40):
        f = whitening.factor(m - shift * np.eye(30))
        assert f.above() == (e > shift).sum()
        b = np.arange(30.0)
        assert np.allclose((m - shift * np.eye(30)) @ f.solve(b, 1e-300), b, atol=1e-6)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    good = [[0.5, -0.25, 1.0], [0.5, -0.25, 1.0], [1.5, 0.0, 2.0], [-3.0, 1.0, 0.125], [0.0, 0.0, 0.0], [1e3, 2e-9, -1e3], [7.0, 7.0, 7.1]]
    bad = [None, [None, 1.0, 2.0], [nan, 1.0, 2.0], [inf, 1.0, 2.0], [-inf, 0.0, 0.0], [], [1e300, 0.0, 0.0]]
    rows = [(i, v, "a", "b") for i, v in enumerate(good + bad)] + [(None, good[2], "a", "b"), (2, good[2], "a", "b")]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 * (len(good) + 2) and [r.vec_id for r in got].count(None) == 3 and [r.vec_id for r in got].count(2) == 6
    x, n, s, e, v = expected(good)
    assert {r.n for r in got} == {n} == {6}
    for r in got:
        if r.vec_id is not None:
            assert r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[r.vec_id], s))
            assert abs(abs(r.whitened) - abs((x[r.vec_id] - s / n) @ v[:, r.component - 1] / np.sqrt(e[r.component - 1]))) < 1e-6
    assert max(r.identity_error for r in got) < 1e-4
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([r for r in rows if r[1] in bad], SCHEMA)).count() == 0


def test_no_variance_and_lengths(spark):
    rows = [(i, [2.0, 3.0], "", "") for i in range(5)] + [(10 + i, [float(i), 2.0 * i, 1.0, float(i % 2)], "", "") for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    flat = [r for r in got if r.vec_id < 10]
    assert len(flat) == 10 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, 0.0, 0.0) for r in flat)
    other = [r for r in got if r.vec_id >= 10]
    assert len(other) == 36 and {r.n for r in other} == {9} and {r.component for r in other if r.whitened is None} == {3, 4}  # rank 2
    assert max(r.identity_error for r in other) < 1e-9


def test_large_numbers(spark):
    """Integers beyond 32 bits and deviations beyond 64."""
    rows = [(i, [float(i) * 1e9, 1.0], "", "") for i in range(1, 4)] + [(9, [1e15, 0.0], "", "")]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()}
    x, n, s, _, _ = expected([r[1] for r in rows])
    for i, row in zip((1, 2, 3, 9), x):
        want = sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))
        assert got[i] == (want if want < 2**63 else None)
