"""Pair heads against listing every pair."""

import itertools

import numpy as np
import pytest

from rosterlens.operators import pair_heads as PH

N, D, T, K = 60, 4, 3, 4


def table(spark, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(N, D))
    y = x[:, :T] + 0.5 * r.normal(size=(N, T))
    y[7, 1] = np.nan
    fold = np.arange(N) % K
    rows = [(i, int(fold[i]), {"bank": x[i].tolist(), "level": [float(np.nan_to_num(y[i]).mean())]}, y[i].astype("<f8").tobytes()) for i in range(N)]
    return x, y, fold, spark.createDataFrame(rows, "model_id long, fold int, x struct<bank:array<double>,level:array<double>>, y binary").repartition(5)


def ridge(a, b, t):
    """Fitted on a with targets b, applied to t; strength by generalised cross-validation."""
    mu, sd = a.mean(0), a.std(0)
    sd = np.where(sd > 1e-9, sd, 1)
    z, best = (a - mu) / sd, (np.inf, None)
    for s in PH.ALPHAS:
        inv = np.linalg.inv(z.T @ z + s * np.eye(z.shape[1]))
        coef = inv @ z.T @ (b - b.mean(0))
        rss = ((b - b.mean(0) - z @ coef) ** 2).sum()
        error = rss / (len(a) - 1 - np.trace(inv @ z.T @ z)) ** 2
        if error < best[0]:
            best = (error, coef)
    return b.mean(0) + ((t - mu) / sd) @ best[1]


def listed(x, y, fold, features, target):
    """{fold: (targets, scores)} of held-out pairs, all pairs written down."""
    pairs = [(i, j) for i, j in itertools.combinations(range(N), 2)]
    f = np.concatenate([features(x[i], x[j : j + 1]) for i, j in pairs])
    t = np.concatenate([target(y[i], y[j : j + 1]) for i, j in pairs])
    ok = ~np.isnan(t).any(axis=1)
    a, b = np.array(pairs).T
    out = {}
    for k in range(K):
        train, test = ok & (fold[a] != k) & (fold[b] != k), ok & (fold[a] == k) & (fold[b] == k)
        out[k] = (t[test], ridge(f[train], t[train], f[test]))
    return out


def auroc(y, p):
    order = np.sort(p)
    rank = (np.searchsorted(order, p, "left") + np.searchsorted(order, p, "right") + 1) / 2
    n1, n0 = (y >= 0.5).sum(), (y < 0.5).sum()
    return (rank[y >= 0.5].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


@pytest.mark.parametrize("block", [11, 1000])
def test_wins_equal_a_head_on_all_listed_pairs(spark, block):
    x, y, fold, rows = table(spark)
    counts = PH.pair_scores(rows, (T,), [(PH.signed_differences, "bank")], PH.wins, T, True, block=block, digits=9)
    got = {(r["fold"], r["target"]): r for r in PH.counted_auroc(counts).collect()}
    for k, (t, p) in listed(x, y, fold, PH.signed_differences, PH.wins).items():
        for c in range(T):
            assert got[k, c]["n"] == len(t)
            assert got[k, c]["auroc"] == pytest.approx(auroc(t[:, c], np.round(p[:, c], 9)), abs=1e-9)
            assert got[k, c]["accuracy"] == pytest.approx(((p[:, c] > 0.5) == (t[:, c] > 0.5)).mean())
            assert got[k, c]["auroc"] > 0.6


def test_distances_equal_a_head_on_all_listed_pairs(spark):
    x, _, fold, _ = table(spark, 1)
    r = np.random.default_rng(2)
    level = r.random((N, 1))
    q = 9
    e = r.normal(size=(N, q, D)) + 2 * x[:, None, :]
    e /= np.linalg.norm(e, axis=2, keepdims=True)
    e[r.random((N, q)) < 0.25] = np.nan
    e = e.astype("<f4").astype(float)
    rows = [(i, int(fold[i]), {"bank": x[i].tolist(), "level": level[i].tolist()}, e[i].astype("<f4").tobytes()) for i in range(N)]
    df = spark.createDataFrame(rows, "model_id long, fold int, x struct<bank:array<double>,level:array<double>>, y binary")
    target = PH.mean_distance(4)
    counts = PH.pair_scores(df, (q, D), [(PH.symmetric, "bank"), (PH.level_and_gap, "level")], target, 1, False, "<f4", block=13, digits=9)
    got = {(r["kind"], r["fold"]): r for r in PH.counted_spearman(counts).collect()}
    for kind, (f, z) in enumerate([(PH.symmetric, x), (PH.level_and_gap, level)]):
        for k, (t, p) in listed(z, e, fold, f, target).items():
            rank = lambda v: (np.searchsorted(np.sort(v), v, "left") + np.searchsorted(np.sort(v), v, "right") + 1) / 2
            want = np.corrcoef(rank(np.round(t[:, 0], 9)), rank(np.round(p[:, 0], 9)))[0, 1]
            assert got[kind, k]["n"] == len(t)
            assert got[kind, k]["spearman"] == pytest.approx(want, abs=1e-6)
    assert np.mean([got[0, k]["spearman"] for k in range(K)]) > np.mean([got[1, k]["spearman"] for k in range(K)])


@pytest.mark.parametrize("within", [False, True])
def test_a_tile_holds_one_pair_of_folds_and_every_pair_once(spark, within):
    _, _, fold, rows = table(spark)
    held = {}
    for r in PH.tiles(rows, 6, within).select("tile", "side", "own", "model_id", "fold").collect():
        held.setdefault(r["tile"], []).append(r)
    met = []
    for own in held.values():
        sides = [[r["model_id"] for r in own if r["side"] == s] for s in (0, 1)]
        assert len({r["fold"] for r in own if r["side"] == 0}) <= 1 and len({r["fold"] for r in own if r["side"] == 1}) <= 1
        met += itertools.combinations(sorted(sides[0]), 2) if own[0]["own"] else [tuple(sorted(x)) for x in itertools.product(*sides)]
    want = [(i, j) for i, j in itertools.combinations(range(N), 2) if not within or fold[i] == fold[j]]
    assert sorted(met) == want


def test_distances_of_two_pieces_are_one_matrix_product():
    r = np.random.default_rng(5)
    e = r.normal(size=(30, 7, 3))
    e[r.random((30, 7)) < 0.4] = np.nan
    got = PH.mean_distance(3).block(e[:12], e[12:])[:, :, 0]
    for i in range(12):
        for j in range(18):
            both = ~np.isnan(e[i, :, 0]) & ~np.isnan(e[12 + j, :, 0])
            want = 1 - (e[i, both] * e[12 + j, both]).sum() / both.sum() if both.sum() >= 3 else np.nan
            assert got[i, j] == pytest.approx(want, nan_ok=True)


@pytest.mark.parametrize("own", [False, True])
def test_a_grid_of_a_tile_gives_the_pairs_that_are_formed_one_by_one(own, monkeypatch):
    import pandas as pd

    r = np.random.default_rng(8)
    m = 41
    x, y, ids = r.normal(size=(m, D)), r.integers(0, 5, size=(m, T)) / 4, r.permutation(m)
    y[3, 1] = np.nan
    side = np.zeros(m, int) if own else np.arange(m) % 2
    tile = pd.DataFrame({"side": side, "own": own, "model_id": ids, "x": [{"bank": v} for v in x], "y": [v.astype("<f8").tobytes() for v in y]})
    monkeypatch.setattr(PH, "GRID", (4, 7))
    kinds = [(PH.signed_differences, "bank")]
    got = np.concatenate([z.copy() for (z,) in PH._pairs(tile, (T,), "<f8", kinds, PH.wins)], axis=1)
    plain = [(lambda a, b: PH.signed_differences(a, b), "bank")]
    want = np.concatenate([z for (z,) in PH._pairs(tile, (T,), "<f8", plain, lambda a, b: PH.wins(a, b))], axis=1)
    sort = lambda z: z[:, np.lexsort(z)]
    assert got.shape == want.shape
    assert (sort(got) == sort(want)).all()


@pytest.mark.parametrize("dense", [1, 64, 1 << 20])
def test_counts_are_those_of_the_listed_numbers(dense, monkeypatch):
    monkeypatch.setattr(PH, "DENSE", dense)
    monkeypatch.setattr(PH, "LISTED", 50)
    r = np.random.default_rng(9)
    counts, every = PH.Counts(), []
    for width in (2, 30, 5, 200, 3):
        y, p = r.integers(-1, 2, 100), r.integers(-width, width, 100)
        counts.add(y, p)
        every.append(np.stack([y, p]))
    want, n = np.unique(np.concatenate(every, axis=1), axis=1, return_counts=True)
    got = counts.rows()
    assert (np.stack(got[:2]) == want).all() and (got[2] == n).all()


def answered(r, n, q, dim, share):
    """Vectors of the questions that each of n models answered: a dense array with NaN, and payloads."""
    e = r.normal(size=(n, q, dim))
    e /= np.linalg.norm(e, axis=2, keepdims=True)
    e = e.astype("<f4")
    e[r.random((n, q)) >= share] = np.nan
    return e.astype(float), [PH.answer_bytes(np.flatnonzero(~np.isnan(v[:, 0])), v[~np.isnan(v[:, 0])]) for v in e]


@pytest.mark.parametrize("laid", [1, 1 << 12, 1 << 25])
def test_distances_of_held_answers_equal_those_laid_out_by_question(laid, monkeypatch):
    monkeypatch.setattr(PH, "LAID", laid)
    e, payloads = answered(np.random.default_rng(11), 20, 700, 3, 0.1)
    payloads[3], e[3] = b"", np.nan
    target = PH.AnswerDistance(8, 3)
    held = target.payloads(payloads)
    assert len(held) == 20
    got, want = target.block(held[np.arange(2, 9)], held[np.arange(9, 20)]), PH.mean_distance(8).block(e[2:9], e[9:])
    assert (np.isnan(got) == np.isnan(want)).all() and np.isnan(want[1]).all() and not np.isnan(want).all()
    assert np.allclose(got, want, atol=1e-7, equal_nan=True)


def test_held_answers_score_like_those_laid_out(spark, monkeypatch):
    monkeypatch.setattr(PH, "GRID", (4, 7))
    monkeypatch.setattr(PH, "WIDE", (9, 14))
    x, _, fold, _ = table(spark, 3)
    e, payloads = answered(np.random.default_rng(12), N, 40, 5, 0.4)
    kinds, found = [(PH.symmetric, "bank"), (PH.level_and_gap, "level")], []
    for y, shape, target, more in [
        ([v.astype("<f4").tobytes() for v in e], (40, 5), PH.mean_distance(6), {"block": 13}),
        (payloads, (), PH.AnswerDistance(6, 5), {"block": 8, "sizes": {k: N // K for k in range(K)}}),
    ]:
        rows = [(i, int(fold[i]), {"bank": x[i].tolist(), "level": [float(i)]}, y[i]) for i in range(N)]
        df = spark.createDataFrame(rows, "model_id long, fold int, x struct<bank:array<double>,level:array<double>>, y binary")
        counts = PH.pair_scores(df, shape, kinds, target, 1, False, "<f4", digits=3, **more)
        found.append({(r["kind"], r["fold"]): (r["n"], round(r["spearman"], 4)) for r in PH.counted_spearman(counts).collect()})
    assert found[0] == found[1] and len(found[0]) == 2 * K


def test_no_model_is_copied_to_the_blocks_it_meets(spark):
    """Blocks are written once, and two meet where they are read: the plan moves no rows."""
    _, _, _, rows = table(spark)
    blocks = PH.packed(rows, 6)
    assert blocks.count() == blocks.rdd.getNumPartitions() == 12
    for within in (False, True):
        pairs = PH.met(blocks, within)
        assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.count() == (36 if within else 144)
