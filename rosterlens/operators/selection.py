"""Choosing questions and models: top-K by score, random K, routing argmax, interview sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.draws import keyed_hash

Selector = Callable[[DataFrame, int], DataFrame]

#: Registered question selectors: (cells, seed) -> (question_id, score).
SELECTORS: dict[str, Selector] = {}


def selector(name: str) -> Callable[[Selector], Selector]:
    def add(fn: Selector) -> Selector:
        SELECTORS[name] = fn
        return fn

    return add


def top_k(scored: DataFrame, k: int, seed: int) -> DataFrame:
    """The K highest-scoring questions, ties broken by a keyed hash."""
    if k < 0:
        raise ValueError(f"k must be >= 0, got {k}")
    tie = keyed_hash(seed, "select", F.col("question_id"))
    return (
        scored.withColumn("tie", tie)
        .orderBy(F.col("score").desc_nulls_last(), "tie")
        .limit(k)
        .select("question_id", "score")
    )


def select(cells: DataFrame, name: str, k: int, seed: int) -> DataFrame:
    """Interview questions by a named selector; refuses a selector that repeats a question."""
    if name not in SELECTORS:
        raise ValueError(f"unknown selector {name!r}; known: {sorted(SELECTORS)}")
    return top_k(SELECTORS[name](cells, seed), k, seed)


@selector("random")
def random_scores(cells: DataFrame, seed: int) -> DataFrame:
    """A constant score: the hash tie-break makes the choice."""
    return cells.select("question_id").distinct().withColumn("score", F.lit(0.0))


@selector("discrimination")
def discrimination_scores(cells: DataFrame, seed: int) -> DataFrame:
    from rosterlens.operators.cells import item_statistics

    return item_statistics(cells).select("question_id", F.col("discrimination").alias("score"))


@selector("fisher")
def fisher_scores(cells: DataFrame, seed: int) -> DataFrame:
    """Test information under the fitted two-parameter model."""
    from rosterlens.operators.irt import fit_2pl, test_information

    fit = fit_2pl(cells, seed=seed)
    return test_information(cells, fit)


def route(predicted: DataFrame) -> DataFrame:
    """Per question the model with the highest prediction, lowest id on ties."""
    return predicted.groupBy("question_id").agg(
        F.max_by("model_id", F.struct(F.col("predicted"), -F.col("model_id"))).alias("model_id"),
        F.max("predicted").alias("predicted"),
    )
