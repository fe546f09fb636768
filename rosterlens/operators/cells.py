"""Folding graded draws into cells, and the per-model and per-question means on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlens.functions.ranks import pearson


def fold_cells(draws: DataFrame) -> DataFrame:
    """cells(model_id, question_id, bench, acc, correct, draws): mean grade, strict majority bit."""
    acc = F.avg("correct")
    return draws.groupBy("model_id", "question_id", "bench").agg(
        acc.alias("acc"),
        (acc > 0.5).cast("int").alias("correct"),
        F.count(F.lit(1)).alias("draws"),
    )


def model_coverage(cells: DataFrame, models: DataFrame, questions: DataFrame) -> DataFrame:
    """models joined with (answered, coverage, accuracy); a model with no cell has coverage 0."""
    n_questions = questions.agg(F.count(F.lit(1))).scalar()
    got = cells.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("answered"), F.sum("correct").alias("n_correct")
    )
    return (
        models.join(got, "model_id", "left")
        .withColumn("answered", F.coalesce(F.col("answered"), F.lit(0)))
        .withColumn("coverage", F.col("answered") / n_questions)
        .withColumn(
            "accuracy",
            F.coalesce(F.try_divide(F.col("n_correct").cast("double"), F.col("answered")), F.lit(0.0)),
        )
        .drop("n_correct")
    )


def benchmark_scores(cells: DataFrame, value: str = "acc") -> DataFrame:
    """scores(model_id, bench, score, n); bench NULL is the model's mean over all questions."""
    return (
        cells.rollup("model_id", "bench")
        .agg(F.avg(value).alias("score"), F.count(F.lit(1)).alias("n"))
        .filter(F.col("model_id").isNotNull())
    )


def leaderboard(cells: DataFrame) -> DataFrame:
    """Mean accuracy per model with its competition rank.

    The rank is counted over distinct scores, so no task sorts the model axis.
    """
    from rosterlens.functions.ranks import value_offsets

    score = cells.groupBy("model_id").agg(
        F.round(F.avg("acc"), 9).alias("score"), F.count(F.lit(1)).alias("n_questions")
    )
    neg = score.withColumn("neg", -F.col("score"))
    counts = neg.groupBy("neg").agg(F.count(F.lit(1)).alias("c"))
    ranks = value_offsets(counts, [], "neg", ["c"]).select("neg", (F.col("c_below") + 1).alias("rank"))
    return neg.join(ranks, "neg").drop("neg")


def loo_ability(cells: DataFrame) -> DataFrame:
    """Adds a model's mean over its other questions (``theta``); NULL with a single question."""
    w = cells.groupBy("model_id").agg(F.sum("acc").alias("__s"), F.count(F.lit(1)).alias("__n"))
    return cells.join(w, "model_id").withColumn(
        "theta", F.try_divide(F.col("__s") - F.col("acc"), F.col("__n") - 1)
    ).drop("__s", "__n")


def item_statistics(cells: DataFrame) -> DataFrame:
    """Difficulty, discrimination (correlation with leave-one-out ability) and Fisher information."""
    return (
        loo_ability(cells)
        .groupBy("question_id")
        .agg(
            F.avg("acc").alias("p"),
            F.count(F.lit(1)).alias("n_models"),
            pearson("acc", "theta").alias("discrimination"),
        )
        .withColumn(
            "fisher", F.pow("discrimination", F.lit(2.0)) * F.col("p") * (F.lit(1.0) - F.col("p"))
        )
    )


def dense_bench_index(questions: DataFrame) -> DataFrame:
    """Adds the 0-based index of the benchmark name in sorted order.

    The window runs over the distinct names only.
    """
    names = questions.select("bench").distinct()
    idx = names.withColumn("bench_ix", F.row_number().over(Window.orderBy("bench")) - 1)
    return questions.join(idx, "bench")
