"""Embeddings of models from bits, question text and answer text, as distributed sums.

Bits stay in long form (one row per cell), so neither axis has to fit anywhere. Text blocks have
the encoder's fixed width. Only matrices whose two sides are fixed widths reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlens.functions.draws import normal
from rosterlens.functions.vectors import dot, unit
from rosterlens.operators.banks import sum_vectors
from rosterlens.session import cut_lineage

SD_FLOOR = 1e-9


def column_stats(df: DataFrame, vector: str) -> DataFrame:
    """One row (mean, sd, n): column means and population spreads of an array column."""
    long = df.select(F.posexplode(vector).alias("dim", "x"))
    per = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.count(F.lit(1)).alias("n"))
    row = per.agg(F.array_sort(F.collect_list(F.struct("dim", "m", "s"))).alias("a"), F.max("n").alias("n"))
    return row.select(
        F.transform("a", lambda t: t["m"]).alias("mean"), F.transform("a", lambda t: t["s"]).alias("sd"), "n"
    )


def zscore(df: DataFrame, vector: str, train: Column, out: str, width_scale: bool = False) -> DataFrame:
    """Standardise an array column by the training rows' mean and population spread (floor 1e-9)."""
    stats = column_stats(df.filter(train), vector).select(F.struct("mean", "sd")).scalar()
    scaled = df.withColumn("__s", stats)
    z = F.zip_with(
        F.zip_with(vector, "__s.mean", lambda x, m: x.cast("double") - m),
        "__s.sd",
        lambda x, s: x / F.greatest(s, F.lit(SD_FLOOR)),
    )
    if width_scale:
        z = F.transform(z, lambda x: x / F.sqrt(F.size(vector)))
    return scaled.withColumn(out, z).drop("__s")


def center_bits(cells: DataFrame, train: DataFrame | None = None, value: str = "correct") -> DataFrame:
    """(model_id, question_id, v): bits minus the training mean of their question.

    A missing cell is not a row: it stands at the training mean and contributes nothing.
    """
    fit = cells if train is None else cells.join(train, "model_id", "left_semi")
    mu = fit.groupBy("question_id").agg(F.avg(value).alias("mu"))
    return cells.join(mu, "question_id").select("model_id", "question_id", (F.col(value) - F.col("mu")).alias("v"))


def gram(df: DataFrame, a: str, b: str | None = None) -> np.ndarray:
    """Sum over rows of outer(a, b) for two array columns of fixed width.

    Each partition multiplies its own rows; the partial matrices are summed by row in Spark.
    """
    cols = [a] if b is None else [a, b]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for p in batches:
            if len(p):
                x = np.stack(p[a].to_list())
                y = x if b is None else np.stack(p[b].to_list())
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            yield pd.DataFrame({"r": np.arange(len(total)), "v": list(total)})

    def add(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [key[0]], "v": [np.sum(np.stack(p["v"].to_list()), axis=0)]})

    rows = (
        df.select(*cols).mapInPandas(partial, "r int, v array<double>")
        .groupBy("r").applyInPandas(add, "r int, v array<double>").collect()
    )
    return np.array([r["v"] for r in sorted(rows, key=lambda r: r["r"])])


def apply_matrix(df: DataFrame, vector: str, matrix: np.ndarray, out: str) -> DataFrame:
    """vector . matrix for a fixed-width array column."""
    cols = [F.array(*[F.lit(float(x)) for x in matrix[:, j]]) for j in range(matrix.shape[1])]
    return df.withColumn(out, F.array(*[dot(vector, c) for c in cols]))


def project(bits: DataFrame, loadings: DataFrame, by: str = "question_id", to: str = "model_id") -> DataFrame:
    """(to, vec): sum over the shared key of v * loading; the matrix product in long form."""
    sums = sum_vectors(bits.join(loadings.select(by, "vec"), by), [to], "vec", F.col("v"))
    return sums.select(to, F.col("total").alias("vec"))


def _orthonormal(vectors: DataFrame, key: str) -> DataFrame:
    """Columns of the tall matrix (key, vec) made orthonormal, by the inverse factor of its Gram matrix."""
    g = gram(vectors, "vec")
    lam, u = np.linalg.eigh(g)
    keep = lam > lam.max() * 1e-14
    return apply_matrix(vectors, "vec", u[:, keep] / np.sqrt(lam[keep]), "__o").select(key, F.col("__o").alias("vec"))


def bits_pca(bits: DataFrame, width: int, seed: int = 0, rounds: int = 4, extra: int = 8) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(scores(model_id, vec), singular values, loadings(question_id, vec)) of centred bits.

    Subspace iteration on the long table: a random start of width + extra hashed normals is
    multiplied by the matrix and its transpose in turn. Each product is one join and one sum per
    vector. Signs are fixed so that the largest loading of a component is positive.
    """
    n = width + extra
    start = bits.select("question_id").distinct().select(
        "question_id", F.array(*[normal(seed, "omega", F.col("question_id"), F.lit(j)) for j in range(n)]).alias("vec")
    )
    q = cut_lineage(start)
    for _ in range(rounds):
        y = project(bits, q)
        q = cut_lineage(project(bits, y, by="model_id", to="question_id"))
        q = cut_lineage(_orthonormal(q, "question_id"))
        n = len(q.first()["vec"])
    y = cut_lineage(project(bits, q))
    lam, u = np.linalg.eigh(gram(y, "vec"))
    top = np.argsort(-lam)[: min(width, n)]
    rot = u[:, top]
    loadings = apply_matrix(q, "vec", rot, "__l").select("question_id", F.col("__l").alias("vec"))
    k = rot.shape[1]
    biggest = loadings.agg(
        *[F.max_by(F.get("vec", F.lit(j)), F.struct(F.abs(F.get("vec", F.lit(j))), "question_id")).alias(f"s{j}") for j in range(k)]
    ).first()
    sign = np.array([1.0 if (biggest[j] or 0.0) >= 0 else -1.0 for j in range(k)])
    loadings = apply_matrix(loadings, "vec", np.diag(sign), "__l").select("question_id", F.col("__l").alias("vec"))
    scores = apply_matrix(y, "vec", rot * sign, "__s").select("model_id", F.col("__s").alias("vec"))
    return scores, np.sqrt(np.maximum(lam[top], 0)), loadings


def components_for_share(df: DataFrame, vector: str, share: float = 0.95) -> int:
    """Number of principal components that carry ``share`` of the variance of an array column."""
    stats = column_stats(df, vector).first()
    mean, n = np.array(stats["mean"]), stats["n"]
    cov = gram(df.withColumn("__v", F.transform(vector, lambda x: x.cast("double"))), "__v") - n * np.outer(mean, mean)
    lam = np.maximum(np.linalg.eigvalsh(cov)[::-1], 0)
    if lam.sum() <= 1e-9:
        raise ValueError("every model sits at the same point")
    return int(np.searchsorted(np.cumsum(lam) / lam.sum(), share) + 1)


def block_widths(d: int, blocks: int) -> list[int]:
    """The width split evenly over the blocks, the remainder to the first one."""
    return [d - (blocks - 1) * (d // blocks)] + [d // blocks] * (blocks - 1)


def pls_svd(bits: DataFrame, text: DataFrame, widths: tuple[int, int], train: DataFrame) -> DataFrame:
    """embedding(model_id, vec): two-block fusion of centred bits and centred answer text.

    Each block is projected on the leading singular vectors of its cross-covariance with the
    other block (scaled to unit variance); both block scores are standardised on the training
    models and concatenated. The cross-covariance is question x text width: one sum of text
    vectors per question.
    """
    fit_text = text.join(train, "model_id", "left_semi")
    mean = np.array(column_stats(fit_text, "emb").first()["mean"])
    centred = cut_lineage(
        text.withColumn("vec", F.zip_with("emb", F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m)).select("model_id", "vec")
    )
    fit = centred.join(train, "model_id", "left_semi")
    cross = project(bits.join(train, "model_id", "left_semi"), fit, by="model_id", to="question_id")
    cross = cut_lineage(cross)
    lam, v = np.linalg.eigh(gram(cross, "vec"))
    order = np.argsort(-lam)
    rank = max(int((lam > lam.max() * 1e-12).sum()), 1)
    kb, kt = min(widths[0], rank), min(widths[1], rank)
    vt = v[:, order]
    peak = np.sign(vt[np.abs(vt).argmax(0), np.arange(vt.shape[1])])
    vt = vt * np.where(peak == 0, 1, peak)
    sv = np.sqrt(np.maximum(lam[order], 1e-300))
    load_q = apply_matrix(cross, "vec", vt[:, :kb] / sv[:kb], "__l").select("question_id", F.col("__l").alias("vec"))
    bit_scores = project(bits, load_q).withColumnRenamed("vec", "b")
    text_scores = apply_matrix(centred, "vec", vt[:, :kt], "t").select("model_id", "t")
    both = bit_scores.join(text_scores, "model_id").withColumn("raw", F.concat("b", "t"))
    flagged = both.join(train.select("model_id", F.lit(1).alias("__tr")), "model_id", "left")
    flagged = cut_lineage(flagged)
    return zscore(flagged, "raw", F.col("__tr") == 1, "vec").select("model_id", "vec")


def channel_pca(bits: DataFrame, text: DataFrame, width: int, train: DataFrame) -> DataFrame:
    """embedding(model_id, vec): components of the text block standardised on the training models."""
    flagged = cut_lineage(text.join(train.select("model_id", F.lit(1).alias("__tr")), "model_id", "left"))
    z = cut_lineage(zscore(flagged, "emb", F.col("__tr") == 1, "vec", width_scale=True).select("model_id", "vec", "__tr"))
    lam, v = np.linalg.eigh(gram(z.filter("__tr = 1"), "vec"))
    load = v[:, np.argsort(-lam)[:width]]
    peak = np.sign(load[np.abs(load).argmax(0), np.arange(load.shape[1])])
    text_scores = apply_matrix(z, "vec", load * np.where(peak == 0, 1, peak), "t").select("model_id", "t")
    scores, _, _ = bits_pca(bits, width)
    return scores.withColumnRenamed("vec", "b").join(text_scores, "model_id").select("model_id", F.concat("b", "t").alias("vec"))


#: Groups of models that a question's answers are projected in, and keys a task adds up before it sends the sums on.
PROJECTED, SUMMED = 64, 4096


def _task_sums(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, v): sums of the vector and, behind it, of ones, as far as a task's rows go; ``SUMMED`` keys at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict = {}
        for p in batches:
            if not len(p):
                continue
            code, names = pd.factorize(p[key])
            order = np.argsort(code, kind="stable")
            x = np.stack(p[vector].to_list()).astype(float)[order]
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            sums = np.column_stack([np.add.reduceat(x, first, axis=0), np.diff(np.append(first, len(p)))])
            for name, v in zip(names, sums, strict=True):
                acc[name] = acc[name] + v if name in acc else v
            if len(acc) >= SUMMED:
                yield pd.DataFrame({key: list(acc), "v": list(acc.values())})
                acc = {}
        if acc:
            yield pd.DataFrame({key: list(acc), "v": list(acc.values())})

    return df.select(key, vector).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, v array<double>")


def random_fingerprint(answers: DataFrame, probes: DataFrame, width: int, dim: int, seed: int) -> DataFrame:
    """fingerprint(model_id, vec): the probe answers of a model under one fixed random projection.

    The projection row of (probe, coordinate) is a hashed normal, so the stacked answer is never
    built. A missing answer stands at the probe's mean and adds that mean's projection.
    """
    n = probes.agg(F.count(F.lit(1))).scalar()
    asked = answers.where(F.col("emb").isNotNull()).join(probes.select("question_id"), "question_id")
    sums = sum_vectors(_task_sums(asked, "question_id", "emb"), ["question_id"], "v").select("question_id", "total")
    mean = sums.select("question_id", F.transform(F.slice("total", 1, dim), lambda x: x / F.get("total", F.lit(dim))).alias("mu"))
    rows = mean.select("question_id", F.posexplode("mu").alias("i", "m")).withColumn(
        "vec", F.array(*[normal(seed, "project", F.col("question_id"), F.col("i"), F.lit(j)) for j in range(width)])
    )
    rows = cut_lineage(rows)
    base = sum_vectors(rows, [], "vec", F.col("m")).select("total").scalar()
    # a question's answers meet its matrix in groups of some of the models, so no answer is taken apart
    whole = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("i", "m", "vec"))).alias("c"))
    whole = whole.select("question_id", F.col("c.m").alias("mu"), F.flatten("c.vec").alias("mat"), F.explode(F.sequence(F.lit(0), F.lit(PROJECTED - 1))).alias("bucket"))
    cells = asked.select("model_id", "question_id", "emb", F.pmod(F.xxhash64("model_id"), F.lit(PROJECTED)).cast("int").alias("bucket"))

    def times(key: tuple, p: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({"model_id": p["model_id"], "vec": pd.Series([], dtype=object)})
        # centred answers: a missing one is a zero vector; the mean part is the same for every model
        centred = np.stack(p["emb"].to_list()).astype(float) - m["mu"].iloc[0]
        return pd.DataFrame({"model_id": p["model_id"], "vec": list(centred @ np.reshape(m["mat"].iloc[0], (dim, width)))})

    by = ["question_id", "bucket"]
    moved = cells.groupBy(*by).cogroup(whole.groupBy(*by)).applyInPandas(times, f"model_id {dict(answers.dtypes)['model_id']}, vec array<double>")
    own = sum_vectors(moved, ["model_id"], "vec")
    scale = F.sqrt(n * F.lit(float(dim)))
    return own.withColumn("scale", scale).withColumn("base", base).select(
        "model_id", F.zip_with("total", "base", lambda x, b: x + b).alias("raw"), "scale"
    ).select("model_id", F.transform("raw", lambda x: x / F.col("scale")).alias("vec"))


def fold_in_ridge(bits: DataFrame, loadings: DataFrame, width: int, lam: float = 1.0) -> DataFrame:
    """placed(model_id, vec): held-out models placed by ridge on their observed cells.

    The normal equations of a model are sums over its cells; the small solve runs per model
    inside tasks. A model without cells is not a row and stays at the prior.
    """
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    rows = bits.join(loadings.select("question_id", "vec"), "question_id")
    sums = rows.groupBy("model_id").agg(
        F.array(*[F.sum(F.get("vec", F.lit(i)) * F.get("vec", F.lit(j))) for i, j in pairs]).alias("g"),
        F.array(*[F.sum(F.get("vec", F.lit(i)) * F.col("v")) for i in range(width)]).alias("r"),
    )
    ii = np.array([i for i, _ in pairs])
    jj = np.array([j for _, j in pairs])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            g = np.zeros((len(p), width, width))
            v = np.stack(p["g"].to_list())
            g[:, ii, jj] = v
            g[:, jj, ii] = v
            r = np.stack(p["r"].to_list())
            sol = np.linalg.solve(g + lam * np.eye(width), r[:, :, None])[:, :, 0]
            yield pd.DataFrame({"model_id": p["model_id"], "vec": list(sol)})

    return sums.mapInPandas(solve, f"model_id {dict(bits.dtypes)['model_id']}, vec array<double>")


#: Texts that are encoded in one product.
ENCODED = 64


def hashed_text(texts: DataFrame, text: str, width: int, seed: int = 0, buckets: int = 4096) -> DataFrame:
    """Adds ``emb``: hashed word and bigram counts at unit length, a fixed Gaussian projection, unit length.

    Blank text is the zero vector. Words have two or more characters. The projection of a bucket
    is a pure function of (seed, bucket), built once per task.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    df = texts.withColumn("__w", F.coalesce(words, F.array().cast("array<string>")))
    two = F.zip_with(
        F.slice("__w", F.lit(1), F.greatest(F.size("__w") - 1, F.lit(0))),
        F.slice("__w", F.lit(2), F.greatest(F.size("__w") - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    codes = F.transform(F.concat("__w", two), lambda t: F.pmod(F.hash(t), F.lit(buckets)))
    df = df.withColumn("__c", codes).drop("__w")
    out_type = df.drop("__c").schema.add("emb", T.ArrayType(T.FloatType()))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        proj = np.random.default_rng(seed).standard_normal((buckets, width)) / np.sqrt(width)
        for p in batches:
            out = np.zeros((len(p), width))
            codes = [np.empty(0, np.int64) if c is None else np.asarray(c, np.int64) for c in p["__c"]]
            for start in range(0, len(codes), ENCODED):
                part = codes[start : start + ENCODED]
                row = np.repeat(np.arange(len(part)), [len(c) for c in part])
                pair, n = np.unique(row * buckets + np.concatenate(part), return_counts=True)
                row, code = pair // buckets, pair % buckets
                size = np.sqrt(np.bincount(row, n.astype(float) ** 2, len(part)))
                first = np.flatnonzero(np.diff(row, prepend=-1))
                if len(first):
                    sums = np.add.reduceat((n / size[row])[:, None] * proj[code], first)
                    out[start + row[first]] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)
            yield p.drop(columns="__c").assign(emb=list(out.astype(np.float32)))

    return df.mapInPandas(encode, out_type)


def unit_rows(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn(vector, unit(vector))


def latent_factors(cells: DataFrame, rank: int, seed: int = 0, value: str = "correct") -> DataFrame:
    """embedding(model_id, vec): factors of the model x question table by alternating least squares."""
    from pyspark.ml.recommendation import ALS

    from rosterlens.functions.draws import hash_position, keyed_hash

    def numbered(key: str, out: str) -> DataFrame:
        axis = cells.select(key).distinct().withColumn("__h", keyed_hash(seed, "als", F.col(key)))
        placed = hash_position(axis, [], "__h", key, out).select(key, F.col(out).cast("int").alias(out))
        return cut_lineage(placed)

    users, items = numbered("model_id", "u"), numbered("question_id", "i")
    rows = cut_lineage(cells.join(users, "model_id").join(items, "question_id").select("u", "i", F.col(value).cast("float").alias("r")))
    fit = ALS(rank=rank, userCol="u", itemCol="i", ratingCol="r", seed=seed, regParam=0.1, maxIter=8).fit(rows)
    return fit.userFactors.join(users, F.col("id") == F.col("u")).select(
        "model_id", F.col("features").cast("array<double>").alias("vec")
    )
