"""Whitening against exact sums and eigenvectors of known matrices."""

import math
from fractions import Fraction

import numpy as np
import pytest

from rosterlens.llm import queries, whitening

NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def integers(rows):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    return good, [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in good]


def check(rows, got, components=32, dims=None):
    """Exact counts and deviations, whitened coordinates with unit covariance that are projections on eigenvectors."""
    good, x = integers(rows)
    n, dims = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x, strict=True)]
    deviation = {(i, sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))) for (i, _), v in zip(good, x, strict=True)}
    k = min(components, dims)
    assert len(got) == n * k
    assert {(r.vec_id, r.deviation) for r in got} == deviation
    assert {r.n for r in got} == {n}
    off = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums, strict=True)] for v in x])
    cov = off.T @ off / n
    values = np.linalg.eigvalsh(cov)[::-1]
    for j in range(1, k + 1):
        share = {r.explained for r in got if r.component == j}
        assert len(share) == 1
        assert share.pop() == pytest.approx(values[j - 1] / np.trace(cov), rel=1e-9, abs=1e-15)
    return off, cov, values


def test_given_embeddings(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    out = queries.QUERIES["op11_embedding_whitening"](spark, sf)
    assert out.columns == NAMES
    got = out.collect()
    off, cov, values = check(rows, got)
    assert {r.identity_error for r in got} == {max(r.identity_error for r in got)}
    assert got[0].identity_error < 1e-10
    y = {(r.vec_id, r.component): r.whitened for r in got}
    w = np.array([[y[i, j] for j in range(1, 33)] for i, _ in rows])
    assert np.abs(w.T @ w / len(rows) - np.eye(32)).max() < 1e-10
    basis = np.linalg.lstsq(off, w * np.sqrt(values[:32]), rcond=None)[0]
    assert np.abs(cov @ basis - basis * values[:32]).max() < 1e-9 * values[0]


def test_odd_rows(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=4).tolist()) for i in range(40)]
    rows += [(40, None), (41, []), (42, [1.0, None, 0.0, 0.0]), (43, [1.0, math.nan, 0.0, 0.0]), (44, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(None, [0.5, 0.25, -1.0, 2.0]), (3, [0.5, 0.25, -1.0, 2.0]), (3, rows[3][1])]
    clashing = [(i, v, "x", 1.0, 2) for i, v in rows]
    df = spark.createDataFrame(clashing, "vec_id long, embedding array<double>, vector string, whitened double, n int").repartition(3)
    got = whitening.whitened(df, components=3).collect()
    check(rows, got, 3)
    other = spark.createDataFrame([*rows, (50, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whitened(other).where("vec_id = 50").count() == 0
    assert whitening.whitened(df.limit(0)).columns == NAMES
    assert whitening.whitened(df.limit(0)).count() == 0


def test_no_spread(spark):
    one = whitening.whitened(spark.createDataFrame([(1, [0.5, 1.5])], "vec_id long, embedding array<double>")).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    rows = [(i, [float(i), float(2 * i), 1.0]) for i in range(5)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in got)
    assert got[0].identity_error < 1e-12


def test_wide_values(spark):
    rows = [(i, [1e6 * i, -3e5 * (i % 7)]) for i in range(60)] + [(60, [1e300, 0.0])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 122
    assert got[0].identity_error < 1e-9


def spread(values, seed):
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))[0]
    m = (q * values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1, 31) ** 2.0,
        np.concatenate([np.full(8, 5.0), np.linspace(1, 2, 9)]),  # equal ones
        np.concatenate([3 + np.arange(6) * 1e-9, [1.0, 2.0, 7.0]]),  # closer than single precision tells
        np.concatenate([1 + np.arange(5) * 1e-13, np.arange(5) * 1e-6]),
        np.zeros(4),
    ],
)
def test_eigenvectors(values):
    a = spread(values, len(values))
    found, x = whitening.eigenvectors(a)
    size = max(np.abs(a).max(), 1e-300)
    wide = x.astype(np.longdouble)
    assert np.all(np.diff(found) <= 0)
    assert np.abs(wide.T @ wide - np.eye(len(a))).max() < 1e-15
    assert np.abs(a.astype(np.longdouble) @ wide - wide * found).max() < 2e-15 * size * len(a)
    assert np.allclose(found, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-14 * size * len(a))


def test_exact_products():
    a = np.array([[1 << 30, 3], [-(1 << 30), 5], [7, 1 << 20]], np.int64)
    want = [[sum(int(a[r, i]) * int(a[r, j]) for r in range(3)) for j in range(2)] for i in range(2)]
    assert whitening.product(a).tolist() == want
    assert whitening.product(a // 1024).tolist() == (a // 1024).astype(object).T.dot((a // 1024).astype(object)).tolist()
