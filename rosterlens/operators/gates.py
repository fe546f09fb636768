"""Quality gates on the model axis, with the reason every dropped or flagged model gets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed gate levels.
MIN_COVERAGE = 0.99
COVERAGE_FLOOR = 0.9
DEGENERATE_ACCURACY = 0.01
BAD_SLUG_PATTERNS = ("qwenvergence", "qwestion", "-tainted", "smoke-test")


def contains_any(text: Column | str, tokens: Sequence[str]) -> Column:
    """Case-insensitive: does the text hold any of the tokens?"""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.exists(F.array(*[F.lit(t.lower()) for t in tokens]), lambda t: F.contains(low, t))


def slug_gate(models: DataFrame, name: str, patterns: Sequence[str] = BAD_SLUG_PATTERNS) -> DataFrame:
    """Adds ``reason`` to bad slugs (NULL on the kept ones)."""
    return models.withColumn("reason", F.when(contains_any(name, patterns), F.lit("bad slug")))


def coverage_gate(coverage: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Keeps models that answered at least ``min_coverage`` of the question axis."""
    return coverage.filter(F.col("coverage") >= min_coverage)


def _percent(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def quality_report(
    coverage: DataFrame,
    floor: float = COVERAGE_FLOOR,
    degenerate: float = DEGENERATE_ACCURACY,
) -> DataFrame:
    """qc(model_id, status, reasons, coverage, accuracy).

    ``coverage`` may carry n_rows and n_empty (logged and blank responses of a model).
    """
    has_log = {"n_rows", "n_empty"} <= set(coverage.columns)
    n_rows = F.col("n_rows") if has_log else F.lit(None).cast("bigint")
    n_empty = F.col("n_empty") if has_log else F.lit(None).cast("bigint")
    empty = F.try_divide(n_empty.cast("double"), n_rows)
    floor_text = f"{floor:.0%}"
    dropped = F.when(
        F.col("coverage") < floor,
        F.when(F.col("coverage") == 0, F.lit("no responses collected")).otherwise(
            F.concat(F.lit("coverage "), _percent(F.col("coverage"), 2), F.lit(f" below the {floor_text} floor"))
        ),
    ).when(F.col("accuracy") == 0, F.lit("zero valid outputs across all covered cells"))
    flags = F.filter(
        F.array(
            F.when(n_rows == 0, F.lit("no rows in the response logs")),
            F.when(empty == 1, F.lit("every response was empty")).when(
                empty > 0.5, F.concat(_percent(empty, 1), F.lit(" of responses were empty"))
            ),
            F.when(
                F.col("accuracy") <= degenerate,
                F.concat(
                    F.lit("accuracy "),
                    _percent(F.col("accuracy"), 2),
                    F.lit(" at or below the degenerate-accuracy gate"),
                ),
            ),
        ),
        lambda x: x.isNotNull(),
    )
    reasons = F.when(dropped.isNotNull(), F.array(dropped)).otherwise(flags)
    return coverage.select(
        "model_id",
        F.when(dropped.isNotNull(), "dropped").when(F.size(flags) > 0, "flagged").otherwise("kept").alias("status"),
        F.array_join(reasons, "; ").alias("reasons"),
        "coverage",
        "accuracy",
    )


def drop_degenerate(coverage: DataFrame, threshold: float = DEGENERATE_ACCURACY) -> DataFrame:
    return coverage.filter(F.col("accuracy") > threshold)


def core_view(cells: DataFrame, core: DataFrame, n_core: int | Column, models: DataFrame) -> DataFrame:
    """Means on the core questions of all ``models``, an unanswered cell counting as incorrect.

    The grid is never filled: a missing cell adds 0 to the sum, so the core size is the divisor. A
    model without a core cell has 0, with the whole core written as incorrect.
    """
    got = (
        cells.join(core, "question_id", "left_semi")
        .groupBy("model_id")
        .agg(F.sum("correct").alias("right"), F.count(F.lit(1)).alias("answered"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return models.select("model_id").join(got, "model_id", "left").select(
        "model_id",
        (zero("right") / n_core).alias("core_accuracy"),
        (n_core - zero("answered")).cast("bigint").alias("written_as_incorrect"),
    )
