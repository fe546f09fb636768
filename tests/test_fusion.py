"""Fusion and components of all folds at once against one direct fit per fold."""

import numpy as np
import pytest

from rosterlens.operators import fusion as FU

FOLDS, NM, NQ, DQ, DT = 3, 80, 150, 7, 9


def tables(spark, seed=0, missing=0.15):
    r = np.random.default_rng(seed)
    a = (r.random((NM, NQ)) < r.random(NQ)).astype(float)
    a[r.random((NM, NQ)) < missing] = np.nan
    a[5] = np.nan  # a model without any cell
    e, t = r.normal(size=(NQ, DQ)), r.normal(size=(NM, DT)) + 2
    has = r.random(NM) > 0.1
    fold = np.arange(NM) % FOLDS
    fold[:4], fold[4] = FU.ALWAYS, FU.NEVER
    fold[5] = 1
    frame = spark.createDataFrame
    cells = frame([(i, f"q{j}", float(a[i, j])) for i in range(NM) for j in range(NQ) if not np.isnan(a[i, j])], "model_id long, question_id string, correct double")
    plan = frame([(i, int(fold[i])) for i in range(NM)], "model_id long, fold int")
    qtext = frame([(f"q{j}", e[j].tolist()) for j in range(NQ)], "question_id string, emb array<double>")
    text = frame([(i, t[i].tolist() if has[i] else None) for i in range(NM)], "model_id long, emb array<double>")
    return a, e, t, has, fold, cells, plan, qtext, text


def direct(a, e, t, has, fold, run, channels, widths):
    """One run by plain matrices: {model: vector}, columns up to their sign."""
    train = (fold != run) & (fold != FU.NEVER)
    with np.errstate(all="ignore"):
        mu = np.nanmean(a[train], axis=0)
    v = np.nan_to_num(a - mu)
    k = np.maximum((~np.isnan(a)).sum(axis=1), 1)[:, None]
    blocks = {"bits": v, "qtext": v @ e / k}
    blocks["qtext"] = blocks["qtext"] - blocks["qtext"][train].mean(axis=0)
    tm = t[train & has].mean(axis=0)
    blocks["anstext"] = np.where(has[:, None], t - tm, 0)
    out = []
    for c, w in zip(channels, widths, strict=True):
        others = np.hstack([blocks[o][train] / np.linalg.norm(blocks[o][train]) for o in channels if o != c])
        u = np.linalg.svd(blocks[c][train].T @ others, full_matrices=False)[0][:, :w]
        s = blocks[c] @ u
        if c == "bits":
            for i in np.flatnonzero(fold == run):
                j = ~np.isnan(a[i])
                s[i] = np.linalg.solve(u[j].T @ u[j] + FU.RIDGE * np.eye(u.shape[1]), u[j].T @ v[i, j])
        out.append((s - s[train].mean(axis=0)) / s[train].std(axis=0))
    return np.hstack(out)


def check(got, want, fold, run):
    for row in got:
        assert row["side"] == ("test" if fold[row["model_id"]] == run else "train")
    ids = [r["model_id"] for r in got]
    assert sorted(ids) == [i for i in range(NM) if fold[i] != FU.NEVER]
    x = np.array([r["vec"] for r in got])
    y = want[ids]
    signs = np.sign((x * y).sum(axis=0))
    assert x.shape == y.shape
    assert np.abs(x * signs - y).max() < 1e-7


@pytest.fixture(scope="module")
def gathered(spark):
    *arrays, cells, plan, qtext, text = tables(spark)
    return arrays, FU.gather(cells, plan, qtext, text)


@pytest.mark.parametrize(
    "channels,widths",
    [
        (("bits", "anstext"), (4, 4)),
        (("bits", "qtext"), (4, 3)),
        (("qtext", "anstext"), (3, 3)),
        (("bits", "qtext", "anstext"), (4, 3, 3)),
    ],
)
def test_downdated_fits_equal_direct_ones(gathered, channels, widths):
    arrays, g = gathered
    rows = FU.pls(g, channels, sum(widths)).collect()
    for run in range(FOLDS):
        check([r for r in rows if r["run"] == run], direct(*arrays, run, channels, widths), arrays[-1], run)


def test_downdated_sums_equal_direct_ones(spark):
    a, _, t, has, fold, cells, plan, _, text = tables(spark, 3)
    sums = FU.run_sums(FU.fold_sums(cells, plan, text, DT), FOLDS).collect()
    assert len(sums) == FOLDS * NQ
    for r in sums:
        j, train = int(r["question_id"][1:]), (fold != r["run"]) & (fold != FU.NEVER)
        seen = train & ~np.isnan(a[:, j])
        both = seen & has
        want = [seen.sum(), a[seen, j].sum(), (a[seen, j] ** 2).sum(), both.sum(), a[both, j].sum(), *(a[both, j] @ t[both]), *t[both].sum(axis=0)]
        assert np.abs(np.array(r["total"]) - want).max() < 1e-9


def test_widths_and_channels():
    assert FU.block_widths(32, 2) == [16, 16]
    assert FU.block_widths(32, 3) == [12, 10, 10]
    for bad in (("bits",), ("anstext", "bits"), ("bits", "bits"), ("bits", "other")):
        with pytest.raises(ValueError):
            FU.checked(bad)


def test_wide_blocks_are_cut_at_their_rank(gathered):
    _, g = gathered
    rows = FU.pls(g, ("bits", "qtext"), 40).collect()
    assert {len(r["vec"]) for r in rows} == {2 * DQ}
    assert all(np.isfinite(r["vec"]).all() for r in rows)


def test_many_small_tiles_give_the_same(spark, monkeypatch):
    """Sums leave a tile once for each model or question, so products don't widen the cells; how they are cut changes nothing."""
    monkeypatch.setattr(FU, "TILE_MODELS", 9)
    monkeypatch.setattr(FU, "TILE_QUESTIONS", 40)
    *arrays, cells, plan, qtext, text = tables(spark, 7)
    g = FU.gather(cells, plan, qtext, text)
    tiles = g.tiles.selectExpr("fold", "size(models) m", "size(questions) q", "size(v) v").collect()
    assert len(tiles) >= FOLDS * 2 * 3
    assert sum(t["v"] for t in tiles) == FOLDS * cells.where("model_id <> 4").count()
    assert all(t["v"] <= FOLDS * t["m"] * t["q"] for t in tiles)
    rows = FU.pls(g, FU.CHANNELS, 9).collect()
    for run in range(FOLDS):
        check([r for r in rows if r["run"] == run], direct(*arrays, run, FU.CHANNELS, (3, 3, 3)), arrays[-1], run)


def test_refits_without_questions(spark):
    a, e, t, has, fold, cells, plan, _, text = tables(spark, 4)
    keep = [j for j in range(NQ) if j % 4]
    g = FU.restricted(FU.gather(cells, plan, None, text), spark.createDataFrame([(f"q{j}",) for j in keep], "question_id string"))
    rows = FU.pls(g, ("bits", "anstext"), 6).collect()
    for run in range(FOLDS):
        want = direct(a[:, keep], e[keep], t, has, fold, run, ("bits", "anstext"), (3, 3))
        check([r for r in rows if r["run"] == run], want, fold, run)


def test_components_of_all_folds(spark):
    _, _, _, _, fold, _, plan, _, _ = tables(spark, 5, missing=0)
    r = np.random.default_rng(5)  # bits have no clear leading directions; values with three do
    a = (r.normal(size=(NM, 3)) * [8, 4, 2]) @ r.normal(size=(3, NQ)) / 10 + 0.05 * r.normal(size=(NM, NQ))
    a[5] = np.nan
    cells = spark.createDataFrame([(i, f"q{j}", float(a[i, j])) for i in range(NM) for j in range(NQ) if i != 5], "model_id long, question_id string, correct double")
    rows = FU.bits_components(FU.gather(cells, plan), 3).collect()
    for run in range(FOLDS):
        train = (fold != run) & (fold != FU.NEVER) & ~np.isnan(a[:, 0])
        v = np.nan_to_num(a - a[train].mean(axis=0))
        u = np.linalg.svd(v[train], full_matrices=False)[2][:3].T
        got = {r["model_id"]: r["vec"] for r in rows if r["run"] == run}
        x = np.array([got[i] for i in np.flatnonzero(train)])
        y = v[train] @ u
        assert np.abs(x * np.sign((x * y).sum(axis=0)) - y).max() < 1e-6
        assert got[5] == [0.0] * 3  # no cells: the prior


def test_channels_side_by_side(spark):
    """Components of all standardised columns, one direct decomposition per fold."""
    _, e, t, has, fold, _, plan, qtext, text = tables(spark, 6)
    r = np.random.default_rng(6)
    f = r.normal(size=(NM, 3)) * [8, 4, 2]
    a = f @ r.normal(size=(3, NQ)) / 10 + 0.05 * r.normal(size=(NM, NQ))
    a[r.random((NM, NQ)) < 0.1] = np.nan
    a[5] = np.nan
    cells = spark.createDataFrame([(i, f"q{j}", float(a[i, j])) for i in range(NM) for j in range(NQ) if not np.isnan(a[i, j])], "model_id long, question_id string, correct double")
    rows = FU.channel_components(FU.gather(cells, plan, qtext, text), FU.CHANNELS, 3, rounds=25).collect()
    for run in range(FOLDS):
        train = (fold != run) & (fold != FU.NEVER)
        v = np.nan_to_num(a - np.nanmean(a[train], axis=0))
        q = v @ e / np.maximum((~np.isnan(a)).sum(axis=1), 1)[:, None]
        tm = t[train & has].mean(axis=0)
        parts = [v, q - q[train].mean(axis=0), np.where(has[:, None], t - tm, 0)]
        scaled = []
        for x in parts:
            sd = np.sqrt((x[train] ** 2).mean(axis=0))
            scaled.append(x / np.where(sd > 1e-9, sd, 1) / np.sqrt(x.shape[1]))
        joint = np.hstack(scaled)
        u = np.linalg.svd(joint[train], full_matrices=False)[2][:3].T
        got = {r["model_id"]: r["vec"] for r in rows if r["run"] == run}
        ids = [i for i in range(NM) if fold[i] != FU.NEVER]
        x, y = np.array([got[i] for i in ids]), joint[ids] @ u
        assert np.abs(x * np.sign((x * y).sum(axis=0)) - y).max() < 1e-3
