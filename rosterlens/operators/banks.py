"""Answer-vector banks: pooling, packing, and pair-free dispersion of vectors.

Vector sums are one aggregate over whole vectors. The width is a fixed property of the encoder
(tens to hundreds), so nothing is exploded and a partial sum is as wide as one vector.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.draws import keyed_hash
from rosterlens.functions.vectors import norm, unit

# Fixed values of the packed form.
INT8_TOP = 127.0


def answer_vectors(cells: DataFrame, vectors: DataFrame, seed: int = 0, by: str | None = None) -> DataFrame:
    """answers(model_id, question_id, emb): each cell reads one stored vector by keyed hash.

    ``by`` deals the cells by that column while they are narrow, for sums over it; where the vectors are sent to the cells,
    no vector is then shuffled.
    """
    n = vectors.agg(F.count(F.lit(1))).scalar()
    pick = keyed_hash(seed, "answer", F.col("model_id"), F.col("question_id"))
    keyed = cells.select("model_id", "question_id", (pick % n).alias("vec_id"))
    keyed = keyed.repartition(by) if by else keyed
    return keyed.join(vectors.select("vec_id", "emb"), "vec_id").drop("vec_id")


def question_vectors(questions: DataFrame, vectors: DataFrame, seed: int = 0) -> DataFrame:
    """question_emb(question_id, emb)."""
    n = vectors.agg(F.count(F.lit(1))).scalar()
    keyed = questions.select("question_id", (keyed_hash(seed, "question", F.col("question_id")) % n).alias("vec_id"))
    return keyed.join(vectors.select("vec_id", "emb"), "vec_id").drop("vec_id")


def sum_vectors(df: DataFrame, keys: Sequence[str], vector: str, weight: Column | None = None) -> DataFrame:
    """(keys, total array<double>, n): elementwise sums per group with map-side combine."""
    v = F.col(vector).cast("array<double>")
    if weight is not None:
        v = F.transform(v, lambda x: x * weight)
    return df.select(*keys, array_to_vector(v).alias("__v")).groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(F.col("__v"))).alias("total"), F.count(F.lit(1)).alias("n")
    )


def pooled_text(answers: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Mean covered answer vector per model at unit length; NULL for a model without answers."""
    mean = sum_vectors(answers, ["model_id"], "emb").withColumn(
        "emb", F.transform("total", lambda x: x / F.col("n"))
    )
    pooled = mean.select("model_id", unit("emb").alias("emb"), F.col("n").alias("n_answers"))
    return pooled if models is None else models.select("model_id").join(pooled, "model_id", "left")


def filled_with_mean(pooled: DataFrame, train: Column) -> DataFrame:
    """Models without text take the mean of the training models' pooled vectors."""
    mean = sum_vectors(pooled.filter(train & F.col("emb").isNotNull()), [], "emb").select(
        F.transform("total", lambda x: x / F.col("n"))
    )
    return pooled.withColumn("emb", F.coalesce("emb", mean.scalar()))


def question_block(cells: DataFrame, question_emb: DataFrame, value: str = "correct") -> DataFrame:
    """Correctness-weighted mean question vector per model: (A - column mean) . Q / number of questions."""
    mu = cells.groupBy("question_id").agg(F.avg(value).alias("mu"))
    n = question_emb.agg(F.count(F.lit(1))).scalar()
    rows = cells.join(mu, "question_id").join(question_emb, "question_id")
    sums = sum_vectors(rows, ["model_id"], "emb", F.col(value) - F.col("mu"))
    return sums.withColumn("nq", n).select("model_id", F.transform("total", lambda x: x / F.col("nq")).alias("emb"))


def pack(answers: DataFrame) -> DataFrame:
    """int8 codes and one scale per cell: scale = max|x| / 127 (1 for a zero vector), half to even."""
    top = F.array_max(F.transform("emb", lambda x: F.abs(x))).cast("double")
    scaled = answers.withColumn("scale", F.when(top > 0, (top / INT8_TOP).cast("float")).otherwise(F.lit(1.0).cast("float")))
    return scaled.withColumn(
        "q", F.transform("emb", lambda x: F.rint((x.cast("float") / F.col("scale").cast("float")).cast("double")).cast("tinyint"))
    ).drop("emb")


def unpack(packed: DataFrame) -> DataFrame:
    s = F.col("scale").cast("float")
    return packed.withColumn("emb", F.transform("q", lambda x: (x.cast("float") * s).cast("float"))).drop("q", "scale")


def part_gaps(parts: DataFrame) -> DataFrame:
    """Violations of parts(row_start, row_end, n_models): a gap, an overlap, or a missing end.

    There is one row per part file. A part is sound when another one ends where it starts and
    the last end is the number of models.
    """
    ends = parts.select(F.col("row_end").alias("row_start"))
    first_or_joined = parts.filter("row_start > 0").join(ends, "row_start", "left_anti").select(
        F.col("row_start").alias("at"), F.lit("no part ends here").alias("problem")
    )
    short = parts.agg(F.max("row_end").alias("at"), F.max("n_models").alias("n")).filter("at <> n").select(
        "at", F.lit("rows are missing at the end").alias("problem")
    )
    return first_or_joined.unionByName(short)


def discrepancy(answers: DataFrame, n_models: Column) -> DataFrame:
    """Mean pairwise cosine distance per question, and its coverage, without listing pairs.

    With unit vectors, sum over pairs of the cosine is (|sum e|^2 - n) / 2.
    """
    ones = answers.withColumn("len", norm("emb")).filter("len > 0").withColumn("emb", unit("emb", 1e-12))
    s = sum_vectors(ones, ["question_id"], "emb")
    sq = F.aggregate("total", F.lit(0.0), lambda a, x: a + x * x)
    n = F.col("n")
    return s.select(
        "question_id",
        F.when(n >= 2, 1.0 - (sq - n) / (n * (n - 1.0))).otherwise(0.0).alias("score"),
        (n / n_models).alias("coverage"),
    )


def digest(df: DataFrame) -> DataFrame:
    """Order-free table digest (rows, hash) to tell whether two tables hold the same rows.

    Hashes of the rows' JSON form, which names each column and writes nulls, are summed; so repeated rows
    count and a null in one column differs from a null in another.
    """
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    total = F.coalesce(F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total.cast("string").alias("digest"))
