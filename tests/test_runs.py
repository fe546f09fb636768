"""Protocols: the manifest's tables, refits, skipped arms, scores."""

import numpy as np
import pytest
from test_fusion import FOLDS, NM, NQ, tables

from rosterlens.operators import fusion as FU
from rosterlens.operators import runs as RN


@pytest.fixture(scope="module")
def parts(spark):
    *arrays, cells, plan, qtext, text = tables(spark, 8)
    blocks = spark.createDataFrame([(f"q{j}", f"b{j % 5}", ("eval", "tune", "pool", "pool")[j % 4]) for j in range(NQ)], "question_id string, bench string, block string")
    return arrays, RN.Inputs(cells, plan, None, text, width=6), blocks


@RN.arm("breaks")
def breaks(inputs, seed):
    raise RuntimeError("no such fit")


@pytest.fixture(scope="module")
def done(parts, tmp_path_factory):
    _, inputs, blocks = parts
    root = f"{tmp_path_factory.mktemp('runs')}/protocol"
    RN.fit_runs(inputs, RN.Protocol(blocks, ["pls_bits_anstext", "pls_bits_qtext", "null_random", "text_only", "breaks"], (3, 4), ("b1",)), root)
    return RN.read_runs(inputs.cells.sparkSession, root)


def test_manifest(parts, done):
    arrays, _, _ = parts
    rows = done["run_arms"].collect()
    assert len(rows) == 2 * FOLDS * 2 * 5
    by = {(r["arm"], r["status"], r["reason"]) for r in rows}
    assert ("pls_bits_anstext", "fitted", None) in by
    assert ("pls_bits_qtext", "skipped", "no input: qtext") in by
    assert ("breaks", "skipped", "RuntimeError: no such fit") in by
    fold = arrays[-1]
    for r in rows:
        assert r["n_test"] == (fold == r["fold"]).sum()
        assert r["n_train"] == ((fold != r["fold"]) & (fold != FU.NEVER)).sum()
        assert r["n_fit"] == sum(1 for j in range(NQ) if j % 4 and not (r["refit"] and j % 5 == 1))
        assert (r["width"] is None) == (r["status"] == "skipped")
    vectors = done["run_vectors"].groupBy("refit", "arm", "seed", "run").count().collect()
    assert {(r["arm"], r["seed"]) for r in vectors} == {("pls_bits_anstext", None), ("text_only", None), ("null_random", 3), ("null_random", 4)}


def test_a_refit_reads_no_question_left_out(parts, done):
    _, inputs, blocks = parts
    keep = blocks.where("block <> 'eval' and bench <> 'b1'")
    own = RN.Inputs(inputs.cells.join(keep, "question_id", "left_semi"), inputs.plan, None, inputs.anstext, width=6)
    want = {(r["run"], r["model_id"]): r["vec"] for r in FU.pls(own.gathered(), ("bits", "anstext"), 6).collect()}
    got = done["run_vectors"].where("refit = 'b1' and arm = 'pls_bits_anstext'").collect()
    assert len(got) == len(want)
    for r in got:
        assert np.allclose(r["vec"], want[r["run"], r["model_id"]], atol=1e-8)


def test_cells_are_packed_once_for_all_arms_and_seeds(parts, spark, tmp_path, monkeypatch):
    _, inputs, blocks = parts
    made, tiled = [], FU.tiled
    monkeypatch.setattr(FU, "tiled", lambda cells: made.append(1) or tiled(cells))
    root = f"{tmp_path}/packed"
    RN.fit_runs(inputs, RN.Protocol(blocks, ["pls_bits_anstext", "pls_shuffled_anstext"], (3, 4)), root)
    assert len(made) == 1
    assert {r["status"] for r in RN.read_runs(spark, root)["run_arms"].collect()} == {"fitted"}


def test_errors(parts, spark, tmp_path):
    _, inputs, blocks = parts
    with pytest.raises(ValueError, match="unknown arms"):
        RN.fit_runs(inputs, RN.Protocol(blocks, ["nothing"]), f"{tmp_path}/a")
    with pytest.raises(ValueError, match="eval block is empty"):
        RN.fit_runs(inputs, RN.Protocol(blocks.where("block <> 'eval'"), ["text_only"]), f"{tmp_path}/b")


def test_scores_equal_ridge_by_run(parts, done):
    """The pooled R2 of one arm against plain matrices: strength by leave-one-out, each run by itself."""
    arrays, inputs, _ = parts
    cells = inputs.cells.withColumnRenamed("correct", "acc")
    scores = {(r["arm"], r["seed"], r["run"], r["refit"]): r for r in RN.score_runs(done, cells).collect()}
    a = arrays[0]
    with np.errstate(all="ignore"):
        y = np.nanmean(a[:, ::4], axis=1)
    for run in range(FOLDS):
        rows = done["run_vectors"].where(f"arm = 'pls_bits_anstext' and run = {run} and refit = ''").collect()
        rows = [r for r in rows if not np.isnan(y[r["model_id"]])]
        x, t = np.array([r["vec"] for r in rows]), np.array([y[r["model_id"]] for r in rows])
        side = np.array([r["side"] for r in rows])
        tr = side == "train"
        mu, sd = x[tr].mean(0), x[tr].std(0)
        z, best = (x - mu) / sd, (np.inf, None)
        for s in RN.ALPHAS:
            inv = np.linalg.inv(z[tr].T @ z[tr] + s * np.eye(z.shape[1]))
            h = 1 / tr.sum() + ((z[tr] @ inv) * z[tr]).sum(1)
            p = t[tr].mean() + z @ (inv @ z[tr].T @ (t[tr] - t[tr].mean()))
            best = min(best, ((((t[tr] - p[tr]) / (1 - h)) ** 2).sum(), ((t[~tr] - p[~tr]) ** 2).sum()))
        got = scores["pls_bits_anstext", None, run, ""]
        assert got["sse"] == pytest.approx(best[1], rel=1e-9)
        assert got["n_test"] == (~tr).sum()
    pooled = {(r["refit"], r["arm"]): r for r in RN.pooled_runs(RN.score_runs(done, cells)).collect()}
    assert pooled["", "null_random"]["n_runs"] == 2 * FOLDS
    assert pooled["", "pls_bits_anstext"]["n_runs"] == FOLDS
    assert NM == 80
