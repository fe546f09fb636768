import numpy as np
from pyspark.sql import functions as F

from rosterlens.operators import heads as H


def table(spark, x, y, fold):
    rows = [(i, int(fold[i]), x[i].tolist(), y[i].tolist()) for i in range(len(x))]
    return spark.createDataFrame(rows, "model_id bigint, fold int, x array<double>, y array<double>")


def ridge(z, y, a):
    zc, yb = z - z.mean(0), y.mean(0)
    w = np.linalg.solve(zc.T @ zc + a * np.eye(z.shape[1]), zc.T @ (y - yb))
    return lambda q: yb + (q - z.mean(0)) @ w


def reference(x, y, fold):
    """Brute force: refit without every single row for every strength."""
    out = np.zeros_like(y)
    for f in np.unique(fold):
        tr, te = fold != f, fold == f
        mu, sd = x[tr].mean(0), np.maximum(x[tr].std(0), 1e-9)
        z, yt = (x[tr] - mu) / sd, y[tr]
        errors = []
        for a in H.ALPHAS:
            e = 0.0
            for i in range(len(z)):
                k = np.arange(len(z)) != i
                e += ((yt[i] - ridge(z[k], yt[k], a)(z[i])) ** 2).sum()
            errors.append(e)
        out[te] = ridge(z, yt, H.ALPHAS[int(np.argmin(errors))])((x[te] - mu) / sd)
    return out


def test_oof_ridge_equals_brute_force_leave_one_out(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    y = np.column_stack([x[:, 0] + 0.3 * rng.normal(size=30), rng.normal(size=30)])
    fold = np.arange(30) % 3
    got = H.oof_ridge(table(spark, x, y, fold)).orderBy("model_id").collect()
    assert np.allclose([r["predicted"] for r in got], reference(x, y, fold), atol=1e-8)


def test_per_target_strength_equals_single_target_fits(spark):
    rng = np.random.default_rng(1)
    x, fold = rng.normal(size=(24, 3)), np.arange(24) % 4
    y = np.column_stack([x[:, 0] * 2, rng.normal(size=24)])
    got = np.array([r["predicted"] for r in H.oof_ridge(table(spark, x, y, fold), per_target=True).orderBy("model_id").collect()])
    for j in range(2):
        assert np.allclose(got[:, j], reference(x, y[:, [j]], fold)[:, 0], atol=1e-8)


def test_logistic_one_class_fold_gets_tied_score(spark):
    rows = [(i, i % 2, [float(i), 1.0], 1 if i % 2 == 0 else 0) for i in range(8)]
    df = spark.createDataFrame(rows, "model_id bigint, fold int, x array<double>, label int")
    got = H.oof_logistic(df).orderBy("model_id").collect()
    assert all(r["score"] == 0.0 for r in got)
    assert [r["predicted"] for r in got] == [0, 1] * 4


def test_logistic_separates_and_sits_at_the_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    label = (x[:, 0] + 0.2 * rng.normal(size=60) > 0).astype(int)
    rows = [(i, i % 3, x[i].tolist(), int(label[i])) for i in range(60)]
    got = H.oof_logistic(spark.createDataFrame(rows, "model_id bigint, fold int, x array<double>, label int"))
    assert got.select(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0] > 0.85
    # brute force of one fold: gradient descent on 1/2 |w|^2 + sum of losses, intercept free
    tr = np.arange(60) % 3 != 0
    z = (x - x[tr].mean(0)) / x[tr].std(0)
    w, b = np.zeros(2), 0.0
    for _ in range(20000):
        r = label[tr] - 1 / (1 + np.exp(-(z[tr] @ w + b)))
        w += 0.01 * (z[tr].T @ r - w)
        b += 0.01 * r.sum()
    want = {i: z[i] @ w + b for i in range(0, 60, 3)}
    # a two-class fit keeps half of the margin on each class: its raw value is +-margin / 1
    have = {r["model_id"]: r["score"] for r in got.filter("fold = 0").collect()}
    ratio = np.array([have[i] / want[i] for i in want])
    assert np.allclose(ratio, ratio[0], atol=1e-2)
    assert np.isclose(ratio[0], 1.0, atol=1e-2)


def classes_of(n, k, folds, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) @ np.array([[1, 0.9, 0], [0, 0.3, 0], [0, 0, 5.0]]) + 7
    label = ((x[:, 0] + 0.7 * rng.normal(size=n)) * 1.5).astype(int) % k * 2
    return x, label, np.arange(n) % folds


def test_classes_of_all_folds_equal_fits_by_the_library(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    x, label, fold = classes_of(90, 4, 3)
    label[fold == 0] = np.where(label[fold == 0] == 6, 9, label[fold == 0])  # a class that other folds only know from fold 0
    rows = [(i, int(fold[i]), x[i].tolist(), int(label[i])) for i in range(90)]
    got = {r["model_id"]: r for r in H.oof_logistic(spark.createDataFrame(rows, "model_id bigint, fold int, x array<double>, label int").repartition(4)).collect()}
    for f in range(3):
        tr = fold != f
        z = (x - x[tr].mean(0)) / x[tr].std(0)
        codes = sorted(set(label[tr].tolist()))
        train = spark.createDataFrame([(Vectors.dense(z[i]), float(codes.index(label[i]))) for i in np.flatnonzero(tr)], ["features", "label"])
        m = LogisticRegression(regParam=1 / tr.sum(), standardization=False, maxIter=500, tol=1e-13).fit(train)
        raw = z[~tr] @ m.coefficientMatrix.toArray().T + m.interceptVector.toArray()
        for i, own in zip(np.flatnonzero(~tr), raw):
            assert got[i]["predicted"] == codes[int(own.argmax())] and got[i]["label"] == label[i]
            assert abs(got[i]["score"] - own.max()) < 1e-4


def test_more_folds_take_no_more_passes(spark):
    def jobs(folds):
        x, label, fold = classes_of(160, 3, folds)
        rows = [(i, int(fold[i]), x[i].tolist(), int(label[i])) for i in range(160)]
        df = spark.createDataFrame(rows, "model_id bigint, fold int, x array<double>, label int")
        spark.sparkContext.setJobGroup(f"folds-{folds}", "")
        H.oof_logistic(df).collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds-{folds}"))

    assert jobs(10) < 2 * jobs(2)


def test_a_ridge_turns_few_rows_into_matrices_at_once():
    """Slices follow the number of targets, not the size of the batch that Spark sends."""
    import pandas as pd

    from rosterlens.operators import heads as H

    def batch(rows, targets):
        return pd.DataFrame({"model_id": range(rows), "x": [np.zeros(16)] * rows, "y": [np.zeros(targets)] * rows})

    got = list(H.in_slices(iter([batch(10_000, 1640), batch(0, 3), batch(10_000, 1)])))
    assert sum(map(len, got)) == 20_000 and len(got[-1]) == 10_000
    assert max(8 * len(p) * (16 + len(p["y"].iloc[0])) for p in got) <= H.HELD
    assert len(next(H.in_slices(iter([batch(3, 4_000_000)])))) == 1
