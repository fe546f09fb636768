"""Cases that once came out wrong."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.functions import extract as X
from rosterlens.functions import instructions as I
from rosterlens.operators import banks, cells, gates, irt


def test_digest_counts_repeats_and_places_nulls(spark):
    digest = lambda rows: tuple(banks.digest(spark.createDataFrame(rows, "a int, b int")).first())
    assert digest([(1, 1), (1, 1)]) != digest([(2, 2), (2, 2)])
    assert digest([(None, 1)]) != digest([(1, None)])
    assert digest([(1, 2), (3, 4)]) == digest([(3, 4), (1, 2)])
    assert digest([])[0] == 0


def test_draws_are_counted_whole(spark):
    draws = spark.range(1000).select(F.lit(1).alias("model_id"), F.lit("q").alias("question_id"), F.lit("b").alias("bench"), (F.col("id") % 2).alias("correct"))
    assert cells.fold_cells(draws).first().draws == 1000


def test_core_view_keeps_models_without_core_cells(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "x", 1), (2, "x", 1)], "model_id int, question_id string, correct int")
    core = spark.createDataFrame([("a",), ("b",)], "question_id string")
    models = spark.createDataFrame([(1,), (2,), (3,)], "model_id int")
    got = {r.model_id: (r.core_accuracy, r.written_as_incorrect) for r in gates.core_view(rows, core, 2, models).collect()}
    assert got == {1: (0.5, 1), 2: (0.0, 2), 3: (0.0, 2)}


@pytest.mark.parametrize("text,want", [("```python\nx = 1\n```", "x = 1\n"), ("before\n```python\n", ""), ("no fence", "no fence")])
def test_code_of_open_and_empty_fences(spark, text, want):
    df, t = X.stage(spark.createDataFrame([(text,)], "r string"), F.col("r"), "t")
    assert df.select(X.code(t, t).alias("c")).first().c.strip() == want.strip()


@pytest.mark.parametrize("text", ['{"a": 1}', "[1, 2]", "3", '"x"', "null", '"a" b', '1] , [2', '1}, {"b": 2', '1, "b": 2', "", "{", "a", '```json\n{"a": [null]}\n```'])
def test_json_is_strict(spark, text):
    body = text.removeprefix("```json\n").removesuffix("\n```")
    try:
        json.loads(body)
        want = True
    except ValueError:
        want = False
    assert spark.createDataFrame([(text,)], "r string").select(I.is_json(F.col("r")).alias("x")).first().x is want


def test_abilities_converge_and_information_is_exact(spark):
    r = np.random.default_rng(3)
    items = [(f"q{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(r.uniform(0.5, 2, 30), r.normal(size=30), strict=True))]
    rows = [(m, q, int(m == 9 or r.random() < 0.5)) for m in range(10) for q, _, _ in items]
    df = spark.createDataFrame(rows, "model_id int, question_id string, correct int")
    frame = spark.createDataFrame(items, "question_id string, a double, b double")
    theta = {x.model_id: x.theta for x in irt.fold_in_ability(df, frame).collect()}
    a, b = np.array([x[1] for x in items]), np.array([x[2] for x in items])
    for m in range(10):
        y = np.array([c for i, _, c in rows if i == m])
        p = 1 / (1 + np.exp(-(a * theta[m] + b)))
        assert abs((a * (y - p)).sum() - irt.PENALTY * theta[m]) < 1e-4  # the gradient vanishes, also for all right
    fit = irt.Fit2PL(spark.createDataFrame(list(theta.items()), "model_id int, theta double"), frame)
    got = {x.question_id: x.score for x in irt.test_information(df, fit).collect()}
    for q, ai, bi in items:
        p = 1 / (1 + np.exp(-(ai * np.array(list(theta.values())) + bi)))
        assert abs(got[q] - (ai * ai * p * (1 - p)).sum()) < 1e-9


def test_ranks_of_one_copy_serve_all_permuted_copies(spark):
    """Spearman per copy with the shared ranks of y, and both sides ranked from the rows as they come."""
    from rosterlens.functions import ranks as R

    r = np.random.default_rng(3)
    y = r.normal(size=50).round(1)
    rows = [(d, float(v), float(p)) for d in range(3) for v, p in zip(y if d == 0 else r.permutation(y), r.normal(size=50).round(1))]
    df = spark.createDataFrame(rows, "draw int, y double, p double")
    shared = R.value_ranks(df.where("draw = 0").select("y"), [], "y", "__ra")
    got = {x["draw"]: x["spearman"] for x in R.spearman(df, ["draw"], "y", "p", ranks=shared).collect()}
    own = {x["draw"]: x["spearman"] for x in R.spearman(df, ["draw"], "y", "p").collect()}
    mid = lambda x: (np.searchsorted(np.sort(x), x, "left") + np.searchsorted(np.sort(x), x, "right") + 1) / 2
    for d in range(3):
        a, b = (np.array([x[i] for x in rows if x[0] == d]) for i in (1, 2))
        want = np.corrcoef(mid(a), mid(b))[0, 1]
        assert abs(got[d] - want) < 1e-12 and abs(own[d] - want) < 1e-12
