"""Weighted statistics of all resamples against statistics of the resampled rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import intervals as IV

DRAWS = 60


def midrank(x):
    order = np.sort(x)
    return (np.searchsorted(order, x, "left") + np.searchsorted(order, x, "right") + 1) / 2


def spearman(y, p):
    a, b = midrank(y), midrank(p)
    return np.corrcoef(a, b)[0, 1] if len(y) > 1 and a.std() > 1e-9 and b.std() > 1e-9 else np.nan


def auroc(y, p):
    pos = y >= 0.5
    n1, n0 = pos.sum(), (~pos).sum()
    return (midrank(p)[pos].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) if n1 and n0 else np.nan


def r2(y, p):
    s = ((y - y.mean()) ** 2).sum()
    return 1 - ((y - p) ** 2).sum() / s if s > 1e-9 else np.nan


def macro_f1(y, p):
    out = []
    for c in (0, 1, 2):
        t = 2 * ((y == c) & (p == c)).sum()
        out.append(t / ((y == c).sum() + (p == c).sum()) if t else 0.0)
    return np.mean(out)


DIRECT = {"spearman": spearman, "auroc": auroc, "r2": r2, "macro_f1": macro_f1, "mean": lambda y, p: y.mean(), "ratio": lambda y, p: p.sum() / y.sum()}


def table(kind, n, r):
    if kind == "macro_f1":
        return r.integers(0, 4, n), r.integers(0, 4, n)
    y, p = r.normal(size=n).round(1), r.normal(size=n).round(1)  # ties
    return (np.abs(y) + 0.1, p) if kind == "ratio" else ((y > 0).astype(float), p) if kind == "auroc" else (y, p)


@pytest.mark.parametrize("kind", sorted(DIRECT))
@pytest.mark.parametrize("pairs", [False, True])
def test_all_draws_equal_resampled_rows(spark, kind, pairs):
    r = np.random.default_rng(len(kind) + pairs)
    units = 14
    ends = np.array([(a, b) for a in range(units) for b in range(a)]) if pairs else np.repeat(np.arange(units), r.integers(1, 5, units))[:, None]
    y, p = table(kind, len(ends), r)
    names = ["a", "b"][: ends.shape[1]]
    rows = spark.createDataFrame([(*map(int, e), float(u), float(v)) for e, u, v in zip(ends, y, p, strict=True)], ", ".join(f"{x} long" for x in names) + ", y double, p double").repartition(5)
    every = spark.createDataFrame([(int(u),) for u in range(units)], "unit long")
    weights = IV.draw_weights(every, "unit", DRAWS)
    w = np.zeros((units, DRAWS), int)
    for row in weights.collect():
        w[row["unit"]] = row["w"]
    assert (w.sum(axis=0) == units).all()
    more = {"classes": (0, 1, 2)} if kind == "macro_f1" else {}
    got = {x["draw"]: x["stat"] for x in IV.STATISTICS[kind](IV.weighted(rows, weights, "unit", names), **more).collect()}
    values = []
    for b in range(DRAWS):
        times = np.prod([w[ends[:, i], b] for i in range(ends.shape[1])], axis=0)
        at = np.repeat(np.arange(len(ends)), times)
        want = DIRECT[kind](y[at], p[at])
        values.append(want)
        assert (got[b] is None and np.isnan(want)) or got[b] == pytest.approx(want, abs=1e-9)
    point = float(DIRECT[kind](y, p))
    ci = IV.interval(rows, kind, point, names, DRAWS, **more).first()
    finite = np.array(values)[np.isfinite(values)]
    lo, hi = np.quantile(finite, [0.025, 0.975])
    assert ci["n_units"] == units
    assert (ci["ci_lo"], ci["ci_hi"]) == (pytest.approx(min(lo, point)), pytest.approx(max(hi, point)))


def test_refused_intervals(spark):
    one = spark.createDataFrame([(1, 0.5, 0.5)] * 3, "model_id long, y double, p double")
    assert tuple(IV.interval(one, "mean", 0.5, draws=20).first()) == (None, None, 1)
    flat = spark.createDataFrame([(i, 1.0, float(i)) for i in range(9)], "model_id long, y double, p double")
    assert tuple(IV.interval(flat, "spearman", 0.5, draws=20).first()) == (None, None, 9)
    fine = spark.createDataFrame([(i, float(i), float(i)) for i in range(9)], "model_id long, y double, p double")
    assert tuple(IV.interval(fine, "spearman", None, draws=20).first()) == (None, None, 9)


def test_weights_are_the_draws_of_resample(spark, monkeypatch):
    """Over several blocks and tasks, the packed counts are those of the joined table, narrow enough to keep."""
    from rosterlens.operators.scores import resample

    monkeypatch.setattr(IV, "BLOCK", 16)
    monkeypatch.setattr(IV, "PICKS", 500)
    units = spark.createDataFrame([(i * 7,) for i in range(75)], "unit long")
    got = IV.draw_weights(units, "unit", 20, 3, "ci")
    assert dict(got.dtypes)["w"] == "array<smallint>"
    w = {(r["unit"], d + 1): t for r in got.collect() for d, t in enumerate(r["w"]) if t}
    want = {(r["unit"], r["draw"]): r["times"] for r in resample(units, [], "unit", 20, 3, "ci").collect()}
    assert got.count() == 75 and w == want


def test_a_shared_value_is_ranked_over_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(IV, "PIECE", 40)
    r = np.random.default_rng(5)
    y = np.where(r.random(400) < 0.7, 1.0, r.normal(size=400).round(2))
    w = r.poisson(1.0, (400, 6))
    rows = spark.createDataFrame([(w[i].tolist(), float(y[i])) for i in range(400)], "w array<smallint>, y double").repartition(3)
    ranked = IV.ranked(rows, "y", "rank", 400)
    pieces = ranked.inputFiles()
    assert len(pieces) > 5  # one value holds most rows, and no piece holds them all
    for x in ranked.collect():
        for d in range(6):
            at = np.repeat(y, w[:, d])
            below, same = (at < x["y"]).sum(), (at == x["y"]).sum()
            assert x["rank"][d] == below + (same + 1) / 2


def test_resampled_means_are_those_of_listed_draws(spark, monkeypatch):
    """Several groups, blocks and pieces, a missing unit, rows that share a unit and a key that is missing."""
    from rosterlens.operators import scores as S

    rows = [(g, u if u != 5 else None, float(u * u % 11)) for g, size in (("a|b", 23), ("c", 4), (None, 3), ("d", 1)) for u in range(size)] + [("c", 2, 9.5)]
    df = spark.createDataFrame(rows, "g string, unit int, v double")
    monkeypatch.setattr(S, "BLOCK", 5)
    monkeypatch.setattr(S, "PICKS", 90)
    got = {(r["g"], r["draw"]): r["stat"] for r in S.resampled_means(df, ["g"], "unit", "v", 15, 3, "boot").collect()}
    times = S.resample(df.where("g is not null"), ["g"], "unit", 15, 3, "boot").join(df, ["g", "unit"])
    want = times.groupBy("g", "draw").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("stat")).collect()
    assert got == {(r["g"], r["draw"]): pytest.approx(r["stat"]) for r in want} and len(got) == 45
    plain = {r["draw"]: r["stat"] for r in S.resampled_means(df.where("g = 'c'").drop("g"), [], "unit", "v", 15, 3, "boot").collect()}
    listed = S.resample(df.where("g = 'c'").drop("g"), [], "unit", 15, 3, "boot").join(df.where("g = 'c'"), "unit")
    assert plain == {r["draw"]: pytest.approx(r["stat"]) for r in listed.groupBy("draw").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("stat")).collect()}
