"""Whitening of embeddings by eigenvectors refined from single precision."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps in which entries are counted, the number that stands for zero, and the largest step either way.
SCALE, ORIGIN, LARGEST = 64.0, 1_000_000, 1 << 40
#: Components returned, in production.
COMPONENTS = 32
#: An eigenvalue of at most this share of the largest is taken for zero: such a component has no spread to divide by.
NEGLIGIBLE = 1e-13

#: Exact sums travel as two longs: value = high * 2 ** CUT + low.
CUT = 40


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector) of the rows whose vector has entries, all of them finite; as doubles."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0)).where(~F.coalesce(bad, F.lit(True))).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")
    )


def steps(column: pa.Array, dims: int) -> np.ndarray:
    """The rows' entries as integers."""
    flat = np.floor(SCALE * column.flatten().to_numpy().reshape(-1, dims))
    return np.clip(flat, -LARGEST, LARGEST).astype(np.int64) + ORIGIN


def product(a: np.ndarray) -> np.ndarray:
    """a.T @ a of integers, exact: in doubles where all sums stay below 2 ** 53, else in Python's integers."""
    if not a.size or int(np.abs(a).max()) ** 2 * len(a) < 1 << 53:
        wide = a.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    wide = a.astype(object)
    return wide.T @ wide


def _split(row: np.ndarray) -> dict:
    return {"high": [int(x) >> CUT for x in row], "low": [int(x) & ((1 << CUT) - 1) for x in row]}


def _batches(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.slice(a, 4096)
            yield part, steps(part.column("vector"), dims)


def _totals(dims: int):
    """Each task's sums of the dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, object), 0
        for _, x in _batches(batches, dims):
            total, n = total + (x - ORIGIN).sum(axis=0, dtype=np.int64), n + len(x)
        yield pa.RecordBatch.from_pylist([{"line": 0, "n": n, **_split(total)}], schema=_SUMS)

    return run


_SUMS = pa.schema([("line", pa.int32()), ("n", pa.int64()), ("high", pa.list_(pa.int64())), ("low", pa.list_(pa.int64()))])
SUMS = "line int, n long, high array<long>, low array<long>"


def _products(dims: int, centre: np.ndarray):
    """Each task's products of the centred entries, a row of the matrix at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dims, dims), object), 0
        for _, x in _batches(batches, dims):
            total, n = total + product(x - centre), n + len(x)
        yield pa.RecordBatch.from_pylist([{"line": i, "n": n, **_split(r)} for i, r in enumerate(total)], schema=_SUMS)

    return run


def _added(parts: DataFrame) -> tuple[int, np.ndarray]:
    """The tasks' sums put together by Spark: rows, and one line of integers for each ``line``.

    What reaches the driver has the size of the matrix, however many vectors there are.
    """
    cells = parts.select("line", "n", F.posexplode(F.arrays_zip("high", "low")).alias("at", "v"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    rows = cells.groupBy("line", "at").agg(F.sum("n").alias("n"), wide("v.high").alias("high"), wide("v.low").alias("low")).collect()
    if not rows:
        return 0, np.zeros((0, 0), object)
    out = np.zeros((1 + max(r.line for r in rows), 1 + max(r.at for r in rows)), object)
    for r in rows:
        out[r.line, r.at] = (int(r.high) << CUT) + int(r.low)
    return rows[0].n, out


@dataclass
class Moments:
    """Rows, dimensions, exact sums, and n * n times the covariance, exact."""

    n: int
    dims: int
    sums: np.ndarray
    scaled: np.ndarray

    def covariance(self, kind=np.longdouble) -> np.ndarray:
        return self.scaled.astype(kind) / (kind(self.n) * kind(self.n))


def moments(vectors: DataFrame, dims: int) -> Moments:
    """Of ``vectors(vector)``. Entries are centred before they are multiplied, on the integers next to the means; the rest
    of each mean is taken out of the sums, which are exact integers. So the result doesn't depend on the order of tasks."""
    n, total = _added(vectors.select("vector").mapInArrow(_totals(dims), SUMS))
    if not n:
        return Moments(0, dims, np.zeros(dims, object), np.zeros((dims, dims), object))
    sums = total[0] + n * ORIGIN
    centre = np.array([(2 * int(s) + n) // (2 * n) for s in sums], np.int64)
    _, products = _added(vectors.select("vector").mapInArrow(_products(dims, centre), SUMS))
    rest = sums - n * centre.astype(object)
    return Moments(n, dims, sums, n * products - np.outer(rest, rest))


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One iteration of Ogita and Aishima: better eigenvectors, their eigenvalues, and the gap below which they count as clustered.

    The correction is written as half of what is missing for orthogonality plus a rotation, which is kept exactly
    antisymmetric: divided by a small gap, rounding errors then turn vectors but don't skew them.
    """
    r = np.eye(x.shape[1], dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    norm = lambda m: float(np.sqrt(np.sum(m * m)))
    close = 2 * (norm(s - np.diag(values)) + norm(np.diag(values)) * norm(r))
    gaps = values[None, :] - values[:, None]
    apart = np.abs(gaps) > close
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.where(apart, (s + (values[None, :] + values[:, None]) / 2 * r) / np.where(apart, gaps, 1), 0)
    return x + x @ (r / 2 + turn), values, close


def _clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Runs of sorted values that lie within ``close`` of the next."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > close) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigenvectors(a: np.ndarray, turns: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; eigenvectors as columns) of a symmetric matrix, to double precision.

    The start is LAPACK's float32 eigenvectors. Each iteration corrects all of them by matrix products in a
    precision above double. Where eigenvalues are too close for that, the cluster's block of x.T (a - mu) x, mu its mean,
    is solved by itself: without mu the small differences are no longer lost, and the solution turns the cluster's
    vectors into their right places. Exactly equal eigenvalues stay any orthonormal base of their space.
    """
    a = a.astype(np.longdouble)
    size = np.max(np.abs(a)) if a.size else 0
    if not size:
        return np.zeros(len(a)), np.eye(len(a))
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    done = np.finfo(np.float64).eps / 4
    last = np.inf
    for _ in range(turns):
        better, values, close = _refined(a, x)
        for own in _clusters(values, close):
            mu = np.mean(values[own])
            basis = better[:, own]
            block = basis.T @ (a @ basis - mu * basis)
            scale = np.max(np.abs(block))
            if scale > 0:
                turn = np.linalg.eigh(((block + block.T) / (2 * scale)).astype(np.float64))[1].astype(np.longdouble)
                better[:, own] = basis @ turn
        x = better + better @ (np.eye(len(a)) - better.T @ better) / 2  # turns over tiny gaps are large enough to skew
        residual = x.T @ (a @ x)
        off = float(np.max(np.abs(residual - np.diag(np.diag(residual)))))
        off = max(off, float(np.max(np.abs(np.eye(len(a)) - x.T @ x))))
        if off <= done or (off >= last and last < done * 1e3):
            break
        last = off
    values = np.diag(x.T @ (a @ x)) / np.sum(x * x, axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt(np.sum(x[:, order] * x[:, order], axis=0))
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


@dataclass
class Whitening:
    """What turns a vector into whitened coordinates."""

    moments: Moments
    values: np.ndarray
    basis: np.ndarray  # components as columns
    explained: np.ndarray
    live: np.ndarray  # components with spread

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        m = self.moments
        shift = np.array([int(s) // m.n for s in m.sums], np.int64)
        rest = np.array([int(s) - m.n * int(c) for s, c in zip(m.sums, shift, strict=True)], np.int64)
        near = x - shift
        if near.size and (int(np.abs(near).max()) + 1) * m.n >= 1 << 62:
            return near.astype(object) * m.n - rest
        return near * m.n - rest

    def whitened(self, off: np.ndarray) -> np.ndarray:
        scale = np.where(self.live, 1 / np.sqrt(np.where(self.live, self.values, 1)), np.nan)
        return (off.astype(np.float64) / self.moments.n) @ (self.basis * scale)


def fitted(vectors: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of ``vectors(vec_id, vector)``, fitted on all of them."""
    first = vectors.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = first.dims if first else 0
    m = moments(vectors.where(F.size("vector") == dims), dims)
    values, basis = eigenvectors(m.covariance()) if m.n else (np.zeros(0), np.zeros((dims, 0)))
    trace = float(sum(m.scaled.diagonal())) / float(m.n) ** 2 if m.n else 0.0
    kept = min(components, dims)
    explained = values / trace if trace > 0 else np.full(len(values), np.nan)
    live = values > NEGLIGIBLE * max(values[0], 0) if len(values) else values > 0
    return Whitening(m, values[:kept], basis[:, :kept], explained[:kept], live[:kept])


def _errors(w: Whitening):
    """Each task's sums of whitened coordinates and of their products, in the precision above double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        total = np.zeros((k + 1, k), np.longdouble)
        for _, x in _batches(batches, w.moments.dims):
            y = np.nan_to_num(w.whitened(w.deviations(x)), nan=0.0)
            total[:k] += y.T @ y
            total[k] += y.sum(axis=0)
        yield pa.RecordBatch.from_pylist([{"line": i, "sums": r.astype(np.float64).tolist()} for i, r in enumerate(total)], schema=_LINES)

    return run


_LINES = pa.schema([("line", pa.int32()), ("sums", pa.list_(pa.float64()))])


def identity_error(vectors: DataFrame, w: Whitening) -> float | None:
    """Largest entry of the whitened coordinates' covariance minus the identity, over components with spread; None without any.

    Coordinates are centred already (their means are rounding errors, and are taken out all the same).
    """
    if not w.live.any():
        return None
    parts = vectors.select("vector").mapInArrow(_errors(w), "line int, sums array<double>")
    rows = parts.select("line", F.posexplode("sums").alias("at", "v")).groupBy("line", "at").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((len(w.values) + 1, len(w.values)))
    for r in rows:
        total[r.line, r.at] = r.v
    mean = total[-1] / w.moments.n
    spread = total[:-1] / w.moments.n - np.outer(mean, mean) - np.eye(len(w.values))
    return float(np.max(np.abs(spread[np.ix_(w.live, w.live)])))


def _projected(w: Whitening, error: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        for batch, x in _batches(batches, w.moments.dims):
            off = w.deviations(x)
            y = w.whitened(off).reshape(-1)
            if off.dtype != object and (not off.size or float(np.abs(off).max()) ** 2 * off.shape[1] < 2.0**62):
                squares = np.sum(off * off, axis=1).tolist()
            else:
                squares = [s if s < 1 << 63 else None for s in (sum(int(v) ** 2 for v in r) for r in off)]
            rows = batch.num_rows
            at = np.repeat(np.arange(rows), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, w.moments.n, np.int64)),
                    pa.array(squares, pa.int64()).take(pa.array(at)),
                    pa.array(y, pa.float64(), from_pandas=True),
                    pa.array(np.tile(w.explained, rows), pa.float64(), from_pandas=True),
                    pa.array(np.full(rows * k, np.nan if error is None else error), pa.float64(), from_pandas=True),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whitened(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``vectors(vec_id, <vector>, ...)`` and component: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    A row is usable if its vector has entries and all are finite numbers; where lengths differ, vectors of the commonest length (of
    equally common ones the shortest) are. Each entry c becomes x = floor(64 c) + 1,000,000; beyond 2 ** 40 steps from zero
    it is held at that step. The covariance of x over the usable rows is taken exactly: sums of integers, put together
    by Spark, the products after centring. Its unit eigenvectors, in falling order of eigenvalue, are the components
    (`eigenvectors`): at most ``components``, and no more than there are dimensions.

    ``deviation`` is the exact sum over dimensions of (n x - sum) ** 2, null where that is no 64-bit integer. ``whitened`` is
    x minus its mean, projected, over the root of the eigenvalue; null for a component without spread (an eigenvalue
    of at most 1e-13 of the largest), as with one vector or equal ones. ``explained`` is the eigenvalue's share of the
    trace, null where that is 0. ``identity_error`` is measured on the whitened coordinates of all rows.

    Rows without vec_id and repeated ones are rows like others, each fitted and returned. Of equal eigenvalues any
    orthonormal components may come. An empty table, or one without usable rows, gives no rows; further columns are ignored.
    """
    rows = usable(vectors, vector)
    w = fitted(rows, components)
    rows = rows.where(F.size("vector") == w.moments.dims) if w.moments.n else rows.limit(0)
    error = identity_error(rows, w) if w.moments.n else None
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_projected(w, error), schema)
