import numpy as np

from rosterlens.operators import banks as B
from rosterlens.operators import embed as E


def long(spark, x):
    rows = [(m, f"q{q}", float(x[m, q])) for m in range(x.shape[0]) for q in range(x.shape[1])]
    return spark.createDataFrame(rows, "model_id bigint, question_id string, v double")


def latent(seed, m=40, q=25, d=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(m, d)) * np.array([6.0, 4.0, 2.5]) @ rng.normal(size=(d, q)) + 0.1 * rng.normal(size=(m, q))
    return x - x.mean(0)


def test_bits_pca_equals_dense_svd(spark):
    x = latent(0)
    scores, sv, load = E.bits_pca(long(spark, x), 3, rounds=4)
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(sv[:3], s[:3], rtol=1e-6)
    got = np.array([r["vec"] for r in scores.orderBy("model_id").collect()])
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-4)
    peak = load.collect()
    w = np.array([r["vec"] for r in peak])
    assert (w[np.abs(w).argmax(0), np.arange(3)] > 0).all()


def test_pls_scores_are_standardised_on_training_rows(spark):
    x = latent(1)
    rng = np.random.default_rng(2)
    text = x[:, :6] + 0.1 * rng.normal(size=(40, 6))
    emb = spark.createDataFrame([(m, text[m].tolist()) for m in range(40)], "model_id bigint, emb array<double>")
    train = spark.createDataFrame([(m,) for m in range(30)], "model_id bigint")
    out = E.pls_svd(long(spark, x), emb, (3, 2), train).orderBy("model_id").collect()
    z = np.array([r["vec"] for r in out])
    assert z.shape == (40, 5) and np.isfinite(z).all()
    assert np.allclose(z[:30].mean(0), 0, atol=1e-8) and np.allclose(z[:30].std(0), 1, atol=1e-6)


def test_cross_covariance_energy(spark):
    x = latent(3)
    text = x[:, :4]
    vec = spark.createDataFrame([(m, text[m].tolist()) for m in range(40)], "model_id bigint, vec array<double>")
    c = np.array([r["vec"] for r in E.project(long(spark, x), vec, by="model_id", to="question_id").collect()])
    assert np.isclose((c**2).sum(), (np.linalg.svd(x.T @ text, compute_uv=False) ** 2).sum())


def test_fold_in_solves_the_normal_equations(spark):
    x = latent(4, m=6)
    rng = np.random.default_rng(0)
    w = rng.normal(size=(25, 3))
    load = spark.createDataFrame([(f"q{q}", w[q].tolist()) for q in range(25)], "question_id string, vec array<double>")
    got = np.array([r["vec"] for r in E.fold_in_ridge(long(spark, x), load, 3).orderBy("model_id").collect()])
    want = np.linalg.solve(w.T @ w + np.eye(3), w.T @ x.T).T
    assert np.allclose(got, want, atol=1e-9)


def test_block_widths():
    assert E.block_widths(32, 2) == [16, 16]
    assert E.block_widths(32, 3) == [12, 10, 10]


def test_hashed_text(spark):
    df = spark.createDataFrame([(0, "a small red ring"), (1, "   "), (2, "a small red ring")], "id int, text string")
    e = {r["id"]: np.array(r["emb"]) for r in E.hashed_text(df, "text", 16).collect()}
    assert np.isclose(np.linalg.norm(e[0]), 1, atol=1e-5)
    assert not e[1].any()
    assert np.array_equal(e[0], e[2])


def test_packed_bank_keeps_directions(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(35)] + [(35, [0.0] * 16)]
    df = spark.createDataFrame(rows, "id int, emb array<float>")
    back = B.unpack(B.pack(df)).collect()
    for r in back:
        a, b = np.array(rows[r["id"]][1]), np.array(r["emb"])
        if a.any():
            assert a @ b / np.linalg.norm(a) / np.linalg.norm(b) > 0.999
        else:
            assert not b.any()


def test_missing_part_is_reported(spark):
    parts = spark.createDataFrame([(0, 2, 7), (4, 6, 7)], "row_start int, row_end int, n_models int")
    assert {r["at"] for r in B.part_gaps(parts).collect()} == {4, 6}


def test_effective_rank(spark):
    x = latent(6)
    df = spark.createDataFrame([(m, x[m].tolist()) for m in range(40)], "model_id int, emb array<double>")
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert E.components_for_share(df, "emb") == int(np.searchsorted(np.cumsum(s) / s.sum(), 0.95) + 1)


def test_gram_of_two_blocks(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(20, 3)), rng.normal(size=(20, 2))
    df = spark.createDataFrame([(a[i].tolist(), b[i].tolist()) for i in range(20)], "a array<double>, b array<double>")
    assert np.allclose(E.gram(df.repartition(4), "a", "b"), a.T @ b)


def test_fingerprint_multiplies_whole_answers(spark, monkeypatch):
    """Groups of models meet a question's matrix, and sums leave a task before its keys are many; missing answers stand at the mean."""
    from pyspark.sql import functions as F

    from rosterlens.functions.draws import normal
    from rosterlens.operators import embed as E

    monkeypatch.setattr(E, "SUMMED", 2)
    monkeypatch.setattr(E, "PROJECTED", 3)
    r = np.random.default_rng(4)
    has = {(m, q): r.normal(size=5) for m in range(12) for q in range(6) if (m + q) % 4}
    answers = spark.createDataFrame([(m, f"q{q}", v.tolist()) for (m, q), v in has.items()], "model_id long, question_id string, emb array<double>")
    probes = spark.createDataFrame([(f"q{q}",) for q in range(5)], "question_id string")
    got = E.random_fingerprint(answers.repartition(2), probes, 3, 5, 7)
    assert "posexplode(zip_with" not in got._jdf.queryExecution().toString()
    at = probes.select("question_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    proj = {(x["question_id"], x["i"]): x["v"] for x in at.select("question_id", "i", F.array(*[normal(7, "project", F.col("question_id"), F.col("i"), F.lit(j)) for j in range(3)]).alias("v")).collect()}
    mean = {q: np.mean([v for (_, k), v in has.items() if k == q], axis=0) for q in range(5)}
    rows = got.collect()
    assert len(rows) == 12
    for x in rows:
        want = sum(has.get((x["model_id"], q), mean[q]) @ np.array([proj[f"q{q}", i] for i in range(5)]) for q in range(5)) / 5
        assert np.allclose(x["vec"], want, atol=1e-12)
