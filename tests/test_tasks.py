"""Parts of the evaluation tasks against plain refits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.operators import labels as L
from rosterlens.operators import tasks as TK
from rosterlens.operators.heads import oof_ridge
from rosterlens.operators.splits import k_folds, permutations


def test_residuals_out_of_fold_equal_a_refit_for_each_fold(spark):
    r = np.random.default_rng(1)
    rows = []
    for m in range(40):
        for q in range(6):
            correct = 1 if q == 4 else (None if r.random() < 0.1 else int(r.random() < 0.5))
            rows.append((m, f"q{q}", None if r.random() < 0.05 else float(r.normal() + 2 * (correct or 0)), correct))
    rows += [(m, "rare", float(m), m % 2) for m in range(5)]
    df = spark.createDataFrame(rows, "model_id int, question_id string, rm double, correct int")
    plan = spark.createDataFrame([(m, m % 4) for m in range(40)], "model_id int, fold int")
    got = {(x["model_id"], x["question_id"]): x["residual"] for x in L.residual_out_of_fold(df, plan).collect()}
    for fold in range(4):
        own = L.correctness_residual(df.join(plan, "model_id"), F.col("fold") != fold).where(F.col("fold") == fold)
        for x in own.collect():
            a, b = got[x["model_id"], x["question_id"]], x["residual"]
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9)
    assert len(got) == len(rows)


@pytest.fixture(scope="module")
def bank(spark):
    r = np.random.default_rng(2)
    frame = spark.createDataFrame
    x = r.normal(size=(30, 3))
    vectors = frame([(i, x[i].tolist()) for i in range(30)], "model_id long, vec array<double>")
    cells = [(i, f"q{j}", f"b{j % 3}", float(np.clip(0.5 + 0.2 * x[i, j % 3] + 0.1 * r.normal(), 0, 1))) for i in range(30) for j in range(12)]
    cells = frame(cells, "model_id long, question_id string, bench string, acc double").withColumn("correct", (F.col("acc") > 0.5).cast("int"))
    models = frame([(i, i % 6, float(i) if i % 4 else None, None, i % 2) for i in range(30)], "model_id long, family int, params_b double, vram_gb double, is_chat int")
    return TK.Bench(vectors, cells, models, folds=3, permutations=6, transfer_permutations=3, draws=50)


def test_transfer_nulls_are_fits_of_permuted_banks(bank, spark):
    """Each permuted bank fitted by itself gives the predictions of the shared fit, on that bank's folds."""
    s = bank.benchmark_scores()
    got = TK._per_benchmark(bank, s, "score").collect()
    assert len(got) == 4 * 30 * 3
    perm = permutations(bank.embedding, 3, bank.seed)
    y, axis = TK.wide_target(s, "bench", "score")
    place = {r["pos"] - 1: r["bench"] for r in axis.collect()}
    for draw in range(4):
        if draw:
            own = perm.where(F.col("draw") == draw)
            bankd = own.join(bank.embedding.withColumnRenamed("model_id", "source_id"), "source_id").join(
                bank.fold_plan().withColumnRenamed("model_id", "source_id"), "source_id"
            )
        else:
            bankd = bank.embedding.join(bank.fold_plan(), "model_id")
        rows = bankd.select("model_id", "fold", F.col("vec").alias("x")).join(y, "model_id")
        want = {(r["model_id"], place[i]): p for r in oof_ridge(rows, per_target=True).collect() for i, p in enumerate(r["predicted"])}
        for r in got:
            if r["draw"] == draw:
                assert r["predicted"] == pytest.approx(want[r["model_id"], r["bench"]], abs=1e-9)


@pytest.mark.parametrize("name", ["score_regression", "model_size_regression", "ranking", "cross_benchmark", "error_type", "family_classification", "base_vs_chat", "pairwise", "item_information"])
def test_tasks_have_intervals_around_their_value(bank, name):
    row = TK.TASKS[name].run(bank).first().asDict()
    value = row[TK.TASKS[name].primary]
    assert value is not None
    assert row["ci_lo"] <= value <= row["ci_hi"]
    assert row["n_units"] >= 2
    if name in ("score_regression", "cross_benchmark"):
        assert row["permuted_null"] < value  # the vectors carry the scores


def test_competence_rides_along(bank, spark):
    y = bank.accuracy().select("model_id", (F.col("y") * 2).alias("y"))
    row = TK.scalar_transfer(bank, y, "spearman", competence=True).first()
    assert row["competence_only"] > 0.9


def test_task_table(bank, spark):
    rows = {r["task"]: r for r in TK.task_table(bank).collect()}
    assert set(rows) == set(TK.TASKS)
    assert rows["score_regression"]["runnable"] and rows["score_regression"]["n_labelled"] == 30
    assert rows["rm_mean"]["reason"] == "no measures on this run"
    few = spark.createDataFrame([("x", i, float(i)) for i in range(5)] + [("lb_pt_average", i, float(i)) for i in range(20)], "board string, model_id long, value double")
    other = TK.Bench(bank.embedding, bank.cells, bank.models, few)
    rows = {r["task"]: r for r in TK.task_table(other).collect()}
    assert rows["lb_pt_average"]["runnable"] and rows["lb_pt_average"]["n_labelled"] == 20
    assert rows["i_math_score"]["reason"] == "0 labelled models, 12 needed"
    can, skipped = TK.runnable(other, ["lb_pt_average", "rm_mean", "pairwise"])
    assert can == ["pairwise", "lb_pt_average"] and skipped == {"rm_mean": "no measures on this run"}


def test_fold_schemes(bank):
    assert {"models", "family"} <= set(TK.SCHEMES)
    plan = TK.fold_plan(bank, "family", bank.models).join(bank.models.select("model_id", F.col("family").alias("own")), "model_id")
    assert plan.groupBy("own").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty()
    same = TK.fold_plan(bank, "models", bank.models).join(k_folds(bank.models, 3, bank.seed).withColumnRenamed("fold", "f"), "model_id")
    assert same.where("fold <> f").isEmpty()
    with pytest.raises(ValueError, match="unknown fold scheme"):
        TK.fold_plan(bank, "none", bank.models)


def test_knapsack_reads_all_budgets_and_nulls(bank, spark):
    r = np.random.default_rng(4)
    models = spark.createDataFrame([(i, i % 6, None, float(r.integers(4, 40)), i % 2) for i in range(30)], "model_id long, family int, params_b double, vram_gb double, is_chat int")
    b = TK.Bench(bank.embedding, bank.cells, models, folds=3, draws=40, cache={"knapsack": {"draws": 3, "squads": 4, "permuted": 2}})
    row = TK.knapsack(b).first().asDict()
    for g in (24, 48, 80, 160):
        assert row[f"headroom_at_{g}gb"] <= 1 + 1e-9 or row[f"retention_at_{g}gb"] > 1
        assert 0 < row[f"random_retention_at_{g}gb"] <= row[f"retention_at_{g}gb"] + 0.5
    assert row["n_draws"] == 3 and row["n_null_squads"] == 4 and row["n_models_weighted"] == 30
    assert row["permuted_null"] is not None
    assert row["ci_lo"] <= row["headroom_at_24gb"] <= row["ci_hi"] and row["n_units"] == 3


def test_profiles_of_all_halves_equal_one_decomposition_each(bank, spark):
    """Later components of each half by a direct decomposition, up to sign; columns that lie apart only."""
    r = np.random.default_rng(6)
    f = r.normal(size=(30, 3)) * [6, 3, 1.5]
    a = f @ r.normal(size=(3, 24)) + 0.01 * r.normal(size=(30, 24))
    cells = spark.createDataFrame([(i, f"q{j:02d}", f"b{j % 3}", float(a[i, j])) for i in range(30) for j in range(24) if (i, j) != (4, 1)], "model_id long, question_id string, bench string, acc double")
    b = TK.Bench(bank.embedding, cells, bank.models, draws=30)
    got = {(x["key"], x["model_id"]): x["vec"] for x in TK.half_profiles(b, 2, 1).collect()}
    assert {k for k, _ in got} == set(range(2 + 2 + 2))
    from rosterlens.operators.splits import half_splits

    halves = {(x["draw"], x["question_id"]): x["half"] for x in half_splits(cells.select("question_id").distinct(), 3, b.seed).collect()}
    a[4, 1] = np.nan
    for key, (draw, half, thin) in enumerate([(0, 2, None), (1, 2, None), (2, 1, None), (2, 2, None), (2, 1, 4), (2, 2, 4)]):
        cols = [j for j in range(24) if halves[draw, f"q{j:02d}"] == half]
        rows = [i for i in range(30) if i != thin]
        v = np.nan_to_num(a[np.ix_(rows, cols)] - np.nanmean(a[np.ix_(rows, cols)], axis=0))
        u, s, _ = np.linalg.svd(v, full_matrices=False)
        want = (u * s)[:, 1:3]
        x = np.array([got[key, i] for i in rows])[:, :2]
        assert np.abs(x * np.sign((x * want).sum(axis=0)) - want).max() < 1e-5


def test_specialisation_reports_ceiling_and_null(bank):
    row = TK.specialisation(bank).first().asDict()
    assert row["n_splits"] == 5
    assert row["draw_lo"] <= row["r2_profile_pc2plus"] <= row["draw_hi"]
    assert row["ci_lo"] <= row["r2_profile_pc2plus"] <= row["ci_hi"]
    assert row["target_reliability_lo"] <= row["target_reliability"] <= row["target_reliability_hi"]
    assert row["permuted_null"] < row["r2_profile_pc2plus"]
    assert row["r2_competence"] > 0.3
    assert row["target_reliability_ex_thinnest"] is not None


def test_an_input_is_made_when_a_task_first_reads_it(bank):
    made = []

    def traits():
        made.append(1)
        return bank.models.select("model_id", F.col("model_id").cast("double").alias("log_n_tok"))

    lazy = TK.Bench(bank.embedding, bank.cells, bank.models, labels=lambda: 1 / 0, folds=3, permutations=4, draws=20, cache={"traits": traits})
    assert TK.TASKS["score_regression"].run(lazy).count() == 1 and not made
    for _ in range(2):
        assert TK.TASKS["length_profile"].run(lazy).first()["n_labelled"] == 30
    assert len(made) == 1


def test_a_permutation_brings_both_models_columns(spark):
    got = spark.createDataFrame([(i, i % 3, (i * 7) % 5) for i in range(30)], "model_id long, label int, predicted int")
    value = {r["model_id"]: (r["label"], r["predicted"]) for r in got.collect()}
    plain = {(r["draw"], r["model_id"], r["source_id"]) for r in permutations(got, 4, 7).collect()}
    rows = permutations(got.withColumn("t", F.col("label")), 4, 7, ["predicted"], ["t"]).collect()
    assert {(r["draw"], r["model_id"], r["source_id"]) for r in rows} == plain and len(rows) == 120
    assert all(r["predicted"] == value[r["model_id"]][1] and r["t"] == value[r["source_id"]][0] for r in rows)


def test_answer_divergence_reads_every_question(spark):
    """Two models have only 8 of 720 questions in common; a sample of questions would lose most of them."""
    r = np.random.default_rng(6)
    frame, n = spark.createDataFrame, 40
    x = r.normal(size=(n, 3))
    vectors = frame([(i, x[i].tolist()) for i in range(n)], "model_id long, vec array<double>")
    cells = frame([(i, f"q{j}", "b", float(r.random()), 1) for i in range(n) for j in range(4)], "model_id long, question_id string, bench string, acc double, correct int")
    models = frame([(i, i % 6, 1.0, None, i % 2) for i in range(n)], "model_id long, family int, params_b double, vram_gb double, is_chat int")
    asked = [(i, q) for i in range(n) for q in [f"common{j:03d}" for j in range(8)] + [f"own{i:03d}-{j}" for j in range(18)]]
    answers = frame([(i, q, (np.repeat(x[i], 2) + 0.3 * r.normal(size=6)).tolist()) for i, q in asked], "model_id long, question_id string, emb array<float>")
    b = TK.Bench(vectors, cells, models, folds=4, permutations=3, draws=20, cache={"answers": answers})
    row = TK.answer_divergence(b).first()
    assert row["n_scored_pairs"] == 4 * 10 * 9 // 2 and row["n_folds_scored"] == 4
    assert row["spearman_mean"] > 0.5
