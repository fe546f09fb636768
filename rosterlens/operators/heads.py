"""Out-of-fold heads on an embedding: ridge with a leave-one-out choice of strength, logistic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.session import cut_lineage

# Fixed grid of ridge strengths and the floor on a feature's spread.
ALPHAS = (0.01, 0.1, 1.0, 10.0, 100.0, 1000.0)
SD_FLOOR = 1e-9
#: Bytes of features and targets that a task of a ridge turns into matrices at once; it holds a few matrices of that size.
HELD = 16 << 20


def in_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of rows(x, y) cut to about HELD bytes, whatever the number of targets."""
    for p in batches:
        if len(p):
            rows = max(1, HELD // (8 * (len(p["x"].iloc[0]) + len(p["y"].iloc[0]))))
            for at in range(0, len(p), rows):
                yield p.iloc[at : at + rows]


def fold_sums(df: DataFrame) -> dict[int, np.ndarray]:
    """Per fold the sums of outer([1, x], [1, x, y]); its size depends on the widths only."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for p in in_slices(batches):
            for fold, g in p.groupby("fold"):
                x = np.column_stack([np.ones(len(g)), np.stack(g["x"].to_list())])
                s = x.T @ np.column_stack([x, np.stack(g["y"].to_list())])
                acc[fold] = acc[fold] + s if fold in acc else s
        for fold, s in acc.items():
            yield pd.DataFrame({"fold": fold, "r": np.arange(len(s)), "v": list(s)})

    def add(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [key[0]], "r": [key[1]], "v": [np.sum(np.stack(p["v"].to_list()), axis=0)]})

    schema = "fold int, r int, v array<double>"
    rows = (
        df.select("fold", "x", "y").mapInPandas(partial, schema).groupBy("fold", "r").applyInPandas(add, schema).collect()
    )
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r["fold"], r["r"])):
        out.setdefault(r["fold"], []).append(r["v"])
    return {f: np.array(v) for f, v in out.items()}


def solve_folds(sums: dict[int, np.ndarray], alphas: tuple[float, ...]) -> dict[int, dict]:
    """Standardisation, inverse matrices and coefficients of every strength for every fold's training side."""
    total = sum(sums.values())
    d = total.shape[0] - 1
    fits = {}
    for fold, own in sums.items():
        s = total - own
        n = s[0, 0]
        if n < 1:
            raise ValueError("a fold has no training rows; use at least two folds")
        mu, ybar = s[0, 1 : d + 1] / n, s[0, d + 1 :] / n
        sd = np.maximum(np.sqrt(np.maximum(np.diag(s[1:, 1 : d + 1]) / n - mu**2, 0)), SD_FLOOR)
        g = (s[1:, 1 : d + 1] - n * np.outer(mu, mu)) / np.outer(sd, sd)
        c = (s[1:, d + 1 :] - n * np.outer(mu, ybar)) / sd[:, None]
        inv = np.stack([np.linalg.inv(g + a * np.eye(d)) for a in alphas])
        fits[fold] = {"n": n, "mu": mu, "sd": sd, "ybar": ybar, "inv": inv, "coef": inv @ c}
    return fits


def loo_errors(df: DataFrame, fits: dict[int, dict], alphas: tuple[float, ...]) -> dict[tuple[int, int], np.ndarray]:
    """Sum of squared leave-one-out errors per (fold, strength) and target.

    A row belongs to the training side of every fold but its own. Its error without itself is
    residual / (1 - h) with h = 1/n + x' (G + alpha I)^-1 x.
    """
    fits_b = df.sparkSession.sparkContext.broadcast(fits)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[tuple[int, int], np.ndarray] = {}
        for p in in_slices(batches):
            x, y, own = np.stack(p["x"].to_list()), np.stack(p["y"].to_list()), p["fold"].to_numpy()
            for fold, f in fits_b.value.items():
                keep = own != fold
                if not keep.any():
                    continue
                z, yk = (x[keep] - f["mu"]) / f["sd"], y[keep]
                for i in range(len(alphas)):
                    lev = 1 / f["n"] + ((z @ f["inv"][i]) * z).sum(1)
                    e = (yk - f["ybar"] - z @ f["coef"][i]) / np.maximum(1 - lev, 1e-12)[:, None]
                    acc[fold, i] = acc.get((fold, i), 0) + (e**2).sum(0)
        for (fold, i), v in acc.items():
            yield pd.DataFrame({"fold": [fold], "r": [i], "v": [v]})

    def add(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [key[0]], "r": [key[1]], "v": [np.sum(np.stack(p["v"].to_list()), axis=0)]})

    schema = "fold int, r int, v array<double>"
    rows = (
        df.select("fold", "x", "y").mapInPandas(partial, schema).groupBy("fold", "r").applyInPandas(add, schema).collect()
    )
    return {(r["fold"], r["r"]): np.array(r["v"]) for r in rows}


def oof_ridge(df: DataFrame, alphas: tuple[float, ...] = ALPHAS, per_target: bool = False) -> DataFrame:
    """predicted(model_id, fold, y, predicted) of rows(model_id, fold, x, y): arrays of fixed width.

    All folds and all targets share three passes: sums, leave-one-out errors, predictions. One
    strength serves every target, or each target its own (for permuted copies of a target).
    Features are standardised by the training side; the intercept is not penalised.
    """
    df = cut_lineage(
        df.select("model_id", F.col("fold").cast("int").alias("fold"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))
    )
    fits = solve_folds(fold_sums(df), alphas)
    errors = loo_errors(df, fits, alphas)
    final = {}
    for fold, f in fits.items():
        e = np.stack([errors[fold, i] for i in range(len(alphas))])
        t = f["coef"].shape[2]
        pick = e.argmin(0) if per_target else np.full(t, e.sum(1).argmin())
        coef = f["coef"][pick, :, np.arange(t)].T
        final[fold] = (f["mu"], f["sd"], f["ybar"], coef)
    final_b = df.sparkSession.sparkContext.broadcast(final)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in in_slices(batches):
            x = np.stack(p["x"].to_list())
            out = np.empty((len(p), len(final_b.value[p["fold"].iloc[0]][2])))
            for fold in p["fold"].unique():
                mu, sd, ybar, coef = final_b.value[fold]
                k = (p["fold"] == fold).to_numpy()
                out[k] = ybar + ((x[k] - mu) / sd) @ coef
            yield p.assign(predicted=list(out))[["model_id", "fold", "y", "predicted"]]

    kind = dict(df.dtypes)["model_id"]
    return df.mapInPandas(predict, f"model_id {kind}, fold int, y array<double>, predicted array<double>")


#: Rows that are packed together for a logistic fit; steps it remembers, and the largest gradient entry at which it ends.
PACK, MEMORY, FLAT = 4096, 10, 1e-8


def _packed(df: DataFrame) -> DataFrame:
    """(fold, x, label) of rows(fold, x, label), binary matrices of one fold's rows each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for fold, g in p.groupby("fold"):
                for at in range(0, len(g), PACK):
                    part = g.iloc[at : at + PACK]
                    x, label = np.stack(part["x"].to_list()).astype("<f8"), part["label"].to_numpy().astype("<i4")
                    yield pd.DataFrame({"fold": [fold], "x": [x.tobytes()], "label": [label.tobytes()]})

    return cut_lineage(df.select("fold", "x", "label").mapInPandas(run, "fold int, x binary, label binary"))


def _added(blocks: DataFrame, fn: Callable[[int, np.ndarray, np.ndarray], dict[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """Sums of fn(fold, x, label) over the packed rows by its keys; a task sends one row for each key."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for p in batches:
            for fold, x, label in zip(p["fold"], p["x"], p["label"]):
                y = np.frombuffer(label, "<i4")
                for key, v in fn(fold, np.frombuffer(x, "<f8").reshape(len(y), -1), y).items():
                    acc[key] = acc[key] + v if key in acc else v
        if acc:
            yield pd.DataFrame({"part": TaskContext.get().partitionId(), "key": list(acc), "v": list(acc.values())})

    out: dict[int, np.ndarray] = {}
    for r in sorted(blocks.mapInPandas(partial, "part int, key int, v array<double>").collect(), key=lambda r: (r["key"], r["part"])):
        v = np.array(r["v"])
        out[r["key"]] = out[r["key"]] + v if r["key"] in out else v
    return out


def _logits(z: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """A column for each class; with two classes the first one's is 0 and theta has one row."""
    out = z @ theta[:, 1:].T + theta[:, 0]
    return np.column_stack([np.zeros(len(z)), out]) if len(theta) == 1 else out


class _Descent:
    """Limited-memory quasi-Newton steps of one fold: ``trial`` is where value and gradient are wanted next."""

    def __init__(self, start: np.ndarray, scale: np.ndarray, steps: int) -> None:
        self.trial, self.scale, self.left = start, scale, steps
        self.at, self.value, self.grad, self.pairs, self.done = start, np.inf, None, [], False

    def told(self, value: float, grad: np.ndarray) -> None:
        if self.grad is not None:
            if value > self.value + 1e-4 * self.step * self.slope:
                self.step /= 2
                self.done = self.step < 1e-6
                self.trial = self.at + self.step * self.way
                return
            s, y = self.trial - self.at, grad - self.grad
            if (s * y).sum() > 1e-12 * np.sqrt((s * s).sum() * (y * y).sum()):
                self.pairs = [*self.pairs, (s, y)][-MEMORY:]
        self.at, self.value, self.grad, self.left = self.trial, value, grad, self.left - 1
        self.done = np.abs(grad).max() <= FLAT or self.left < 0
        q, used = grad.copy(), []
        for s, y in reversed(self.pairs):
            a = (s * q).sum() / (s * y).sum()
            used.append(a)
            q -= a * y
        q = q @ self.scale
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s * y).sum() / (y * (y @ self.scale)).sum()
        for (s, y), a in zip(self.pairs, reversed(used)):
            q += (a - (y * q).sum() / (s * y).sum()) * s
        self.way, self.step = -q, 1.0
        self.slope = float((grad * self.way).sum())
        self.trial = self.at + self.way


def oof_logistic(df: DataFrame, c: float = 1.0, max_iter: int = 200) -> DataFrame:
    """scored(model_id, fold, label, predicted, score) of rows(model_id, fold, x, label int).

    Penalised multinomial fit per fold on standardised features: strength 1 / (c n). All folds share the passes: two for the
    spreads, one for each step. A fold that saw one class predicts it with score 0. The score is the margin of the positive class
    with two classes, the largest class margin otherwise (intercepts add up to 0).
    """
    df = cut_lineage(df.select("model_id", F.col("fold").cast("int").alias("fold"), F.col("x").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label")))
    counts: dict[int, dict[int, int]] = {}
    for r in df.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect():  # folds x classes
        counts.setdefault(r["fold"], {})[r["label"]] = r["n"]
    blocks = _packed(df)
    own = _added(blocks, lambda fold, x, y: {fold: np.append(float(len(x)), x.sum(axis=0))})
    total = sum(own.values())
    middle = total[1:] / total[0]
    width = len(middle)
    own2 = _added(blocks, lambda fold, x, y: {fold: ((x - middle).T @ (x - middle)).ravel()})
    total2 = sum(own2.values())
    fits: dict[int, dict] = {}
    runs: dict[int, _Descent] = {}
    for fold in counts:
        n = float((total - own[fold])[0])
        if n < 1:
            raise ValueError("a fold has no training rows; use at least two folds")
        # label codes inside the training side, so that a class it never saw takes no coefficient
        held = {}
        for other, seen in counts.items():
            for label, k in seen.items():
                if other != fold:
                    held[label] = held.get(label, 0) + k
        codes = np.array(sorted(held))
        mu = (total - own[fold])[1:] / n
        cov = (total2 - own2[fold]).reshape(width, width) / n - np.outer(mu - middle, mu - middle)
        sd = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), SD_FLOOR)
        fits[fold] = {"n": n, "mu": mu, "sd": sd, "codes": codes}
        if len(codes) > 1:
            level = np.log([held[k] for k in codes])
            start = np.zeros((1 if len(codes) == 2 else len(codes), width + 1))
            start[:, 0] = level[1] - level[0] if len(codes) == 2 else level - level.mean()
            curve = np.eye(width + 1)
            curve[1:, 1:] = cov / np.outer(sd, sd)
            curve = curve * (1 - 1 / len(codes)) / len(codes) + np.diag(np.append(0.0, np.full(width, 1 / (c * n))))
            runs[fold] = _Descent(start, np.linalg.inv(curve), max_iter)
    while active := {fold: (r.trial, fits[fold]) for fold, r in runs.items() if not r.done}:

        def losses(fold: int, x: np.ndarray, label: np.ndarray, active: dict = active) -> dict[int, np.ndarray]:
            out = {}
            for other, (theta, fit) in active.items():
                if other == fold:
                    continue
                z = (x - fit["mu"]) / fit["sd"]
                p, y = _logits(z, theta), np.searchsorted(fit["codes"], label)
                p -= p.max(axis=1, keepdims=True)
                at = np.arange(len(y))
                top = p[at, y]
                np.exp(p, out=p)
                size = p.sum(axis=1, keepdims=True)
                p /= size
                p[at, y] -= 1
                off = p[:, -len(theta) :]
                grad = np.column_stack([off.sum(axis=0), off.T @ z])
                out[other] = np.append((np.log(size[:, 0]) - top).sum(), grad.ravel())
            return out

        for fold, v in _added(blocks, losses).items():
            theta, fit = active[fold]
            w = theta.copy()
            w[:, 0] = 0.0
            runs[fold].told(float(v[0] + (w * w).sum() / (2 * c)) / fit["n"], (v[1:].reshape(theta.shape) + w / c) / fit["n"])
    for fold, r in runs.items():
        theta = r.at.copy()
        if len(theta) > 1:
            theta[:, 0] -= theta[:, 0].mean()
        fits[fold]["theta"] = theta

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for fold, g in p.groupby("fold"):
                fit = fits[fold]
                at, score = np.zeros(len(g), int), np.zeros(len(g))
                if "theta" in fit:
                    logits = _logits((np.stack(g["x"].to_list()) - fit["mu"]) / fit["sd"], fit["theta"])
                    at = logits.argmax(axis=1)
                    score = logits[:, 1] if logits.shape[1] == 2 else logits.max(axis=1)
                yield g.assign(predicted=fit["codes"][at].astype(np.int32), score=score)[["model_id", "fold", "label", "predicted", "score"]]

    return df.mapInPandas(predict, f"model_id {dict(df.dtypes)['model_id']}, fold int, label int, predicted int, score double")
