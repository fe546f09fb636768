"""Rank statistics as grouped jobs: mid-ranks, AUROC, Spearman, nDCG, macro-F1, R2.

Ranks are built from counts per distinct value, and a group's values are range-split before
any window runs, so a group that holds a third of the table is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Range buckets per group. The split points only steer the work; ranks are exact.
RANK_BUCKETS = 32

EPS = 1e-9


def value_offsets(counts: DataFrame, keys: Sequence[str], value: str, weights: Sequence[str]) -> DataFrame:
    """For one row per (keys, value): the total of each weight over smaller values, as ``<w>_below``."""
    probs = [i / RANK_BUCKETS for i in range(1, RANK_BUCKETS)]
    cuts = counts.groupBy(*keys).agg(
        F.percentile_approx(value, probs, 2000).alias("__cuts")
    )
    if keys:
        split = counts.join(cuts, list(keys))
    else:
        split = counts.withColumn("__cuts", cuts.scalar())
    split = split.withColumn(
        "__b", F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    ).drop("__cuts")
    sums = [F.sum(w).alias(f"__t_{w}") for w in weights]
    totals = split.groupBy(*keys, "__b").agg(*sums)
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "__b", *[F.coalesce(F.sum(f"__t_{w}").over(before), F.lit(0)).alias(f"__o_{w}") for w in weights]
    )
    inside = (
        Window.partitionBy(*keys, "__b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    ranked = split
    for w in weights:
        ranked = ranked.withColumn(f"__i_{w}", F.coalesce(F.sum(w).over(inside), F.lit(0)))
    ranked = ranked.join(offsets, [*keys, "__b"])
    for w in weights:
        ranked = ranked.withColumn(f"{w}_below", F.col(f"__o_{w}") + F.col(f"__i_{w}"))
    return ranked.drop("__b", *[f"__i_{w}" for w in weights], *[f"__o_{w}" for w in weights])


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(keys, value, out): the 1-based rank of every distinct value inside its group, ties averaged."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    return value_offsets(counts, keys, value, ["__c"]).select(
        *keys, value, (F.col("__c_below") + (F.col("__c") + 1) / F.lit(2.0)).alias(out)
    )


def mid_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Adds the 1-based rank of ``value`` inside its group, ties averaged."""
    return df.join(value_ranks(df, keys, value, out), [*keys, value])


def auroc(df: DataFrame, keys: Sequence[str], label: str, score: str, out: str = "auroc") -> DataFrame:
    """Mann-Whitney AUROC per group, ties averaged; NULL where one class is missing.

    ``label`` counts as positive from 0.5 up.
    """
    pos = (F.col(label) >= 0.5).cast("bigint")
    counts = df.groupBy(*keys, score).agg(
        F.sum(pos).alias("__p"), F.sum(1 - pos).alias("__n")
    )
    ranked = value_offsets(counts, keys, score, ["__n"])
    won = F.sum(F.col("__p") * (F.col("__n_below") + F.col("__n") / F.lit(2.0)))
    p, n = F.sum("__p"), F.sum("__n")
    return ranked.groupBy(*keys).agg(
        F.when((p > 0) & (n > 0), won / F.greatest(p * n, F.lit(1))).alias(out),
        p.alias("n_pos"),
        n.alias("n_neg"),
    )


def spearman(df: DataFrame, keys: Sequence[str], a: str, b: str, out: str = "spearman", ranks: DataFrame | None = None) -> DataFrame:
    """Spearman correlation per group; NULL where one side is constant or n < 2.

    Both sides are ranked from the rows as they come. ``ranks(a, __ra)`` are ranks that hold in every group, for groups that
    are orders of the same values.
    """
    rows = df.select(*keys, a, b)
    own = rows.join(value_ranks(rows, keys, a, "__ra"), [*keys, a]) if ranks is None else rows.join(ranks, a)
    ranked = own.join(value_ranks(rows, keys, b, "__rb"), [*keys, b])
    return ranked.groupBy(*keys).agg(pearson("__ra", "__rb").alias(out), F.count(F.lit(1)).alias("n"))


def pearson(a: str, b: str) -> Column:
    """Correlation aggregate that is NULL when a side does not vary."""
    return F.when(
        (F.count(F.lit(1)) >= 2) & (F.stddev_pop(a) >= EPS) & (F.stddev_pop(b) >= EPS), F.corr(a, b)
    )


def top_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, pos: str) -> DataFrame:
    """The first ``k`` rows per group with their 1-based position.

    Spark trims each partition to its own first ``k`` before the shuffle, so the task that
    sorts a group never holds more than k rows per upstream partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(pos, F.row_number().over(w)).filter(F.col(pos) <= k)


def ndcg(df: DataFrame, keys: Sequence[str], gain: str, score: str, tie: str, k: int) -> DataFrame:
    """nDCG@k per group. NULL when a gain is negative or all gains are zero."""
    discount = F.lit(1.0) / F.log2(F.col("__pos") + F.lit(1.0))
    ideal = (
        top_by(df, keys, [F.col(gain).desc(), F.col(tie)], k, "__pos")
        .groupBy(*keys)
        .agg(F.sum(F.col(gain) * discount).alias("__ideal"))
    )
    got = (
        top_by(df, keys, [F.col(score).desc(), F.col(tie)], k, "__pos")
        .groupBy(*keys)
        .agg(F.sum(F.col(gain) * discount).alias("__got"))
    )
    low = df.groupBy(*keys).agg(F.min(gain).alias("__low"))
    return (
        ideal.join(got, list(keys))
        .join(low, list(keys))
        .select(
            *keys,
            F.when((F.col("__low") >= 0) & (F.col("__ideal") > EPS), F.col("__got") / F.col("__ideal")).alias("ndcg"),
        )
    )


def macro_f1(df: DataFrame, keys: Sequence[str], truth: str, predicted: str, classes: DataFrame) -> DataFrame:
    """Mean F1 over the classes of ``classes(cls)``; an undefined F1 counts 0.

    Counts come from one pass: each row adds to its true class and its predicted class.
    """
    side = F.explode(
        F.array(
            F.struct(F.col(truth).alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(predicted)).cast("int").alias("h")),
            F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")),
        )
    )
    counts = (
        df.select(*keys, side.alias("s"))
        .groupBy(*keys, "s.cls")
        .agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum("s.h").alias("h"))
        .join(classes, "cls", "left_semi")
    )
    n_cls = classes.agg(F.countDistinct("cls").alias("n_cls")).scalar()
    # a class nobody holds or predicts adds 0 to the mean, so dividing by n_cls is enough
    return (
        counts.groupBy(*keys)
        .agg(F.sum(F.coalesce(F.try_divide(2.0 * F.col("h"), F.col("t") + F.col("p")), F.lit(0.0))).alias("__s"))
        .select(*keys, (F.col("__s") / n_cls).alias("macro_f1"))
    )


def r2_pooled(df: DataFrame, keys: Sequence[str], column: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """R2 pooled over every column of a target block; NULL when the truth is constant.

    The centred sum of squares of a column is n * var_pop, so one aggregate is enough.
    """
    per = df.groupBy(*keys, *column).agg(
        F.sum(F.pow(F.col(truth) - F.col(predicted), F.lit(2.0))).alias("__e"),
        (F.var_pop(truth) * F.count(F.lit(1))).alias("__t"),
        F.count(F.lit(1)).alias("__n"),
    )
    total = F.sum("__t")
    return per.groupBy(*keys).agg(
        F.when((F.min("__n") >= 2) & (total > EPS), 1 - F.sum("__e") / total).alias("r2"),
        F.sum("__n").alias("n"),
    )


def concordance(df: DataFrame, keys: Sequence[str], truth: str, score: str) -> DataFrame:
    """How many pairs a score orders as the truth does, without listing pairs.

    (keys, concordant, tied, pairs, accuracy): pairs with different truths; pairs the score ties
    count half. Scores are numbered 1..m over their distinct values. Two numbers differ first at
    one binary digit: above it they share a prefix, at it one has 0 and the other 1. So every
    pair is counted in exactly one (digit, prefix) group, as a 0-row with a smaller truth below a
    1-row. That is n log m rows and the range-split running counts used for ranks.
    """
    k = list(keys)
    cells = df.groupBy(*k, score, truth).agg(F.count(F.lit(1)).alias("__c"))
    levels = cells.groupBy(*k, score).agg(F.lit(1).alias("__one"))
    number = value_offsets(levels, k, score, ["__one"]).select(*k, score, F.col("__one_below").cast("bigint").alias("__id"))
    top = number.groupBy(*k).agg(F.max("__id").alias("__top"))
    coded = cells.join(number, [*k, score])
    coded = coded.join(top, k) if k else coded.withColumn("__top", top.scalar())
    digits = F.ceil(F.log2(F.col("__top") + F.lit(2.0))).cast("int")
    split = coded.withColumn("__d", F.explode(F.sequence(F.lit(0), digits))).select(
        *k, truth, "__d", F.call_function("shiftright", F.col("__id"), F.col("__d") + 1).alias("__p"),
        F.when(F.call_function("shiftright", F.col("__id"), F.col("__d")) % 2 == 0, F.col("__c")).otherwise(0).alias("__z"),
        F.when(F.call_function("shiftright", F.col("__id"), F.col("__d")) % 2 == 1, F.col("__c")).otherwise(0).alias("__o"),
    )
    sums = split.groupBy(*k, "__d", "__p", truth).agg(F.sum("__z").alias("__z"), F.sum("__o").alias("__o"))
    won = value_offsets(sums, [*k, "__d", "__p"], truth, ["__z"]).groupBy(*k).agg(
        F.sum(F.col("__o") * F.col("__z_below")).alias("concordant")
    )

    def same(by: list[str], name: str) -> DataFrame:
        c = cells.groupBy(*k, *by).agg(F.sum("__c").alias("__n"))
        return c.groupBy(*k).agg(F.sum(F.col("__n") * (F.col("__n") - 1) / 2).alias(name))

    parts = won
    for other in (same([], "__all"), same([truth], "__t"), same([score], "__s"), same([score, truth], "__st")):
        if k:
            parts = parts.join(other, k)
        else:
            parts = parts.withColumn(other.columns[0], other.scalar())
    pairs, tied = F.col("__all") - F.col("__t"), F.col("__s") - F.col("__st")
    return parts.select(
        *k, F.col("concordant").cast("bigint").alias("concordant"), tied.cast("bigint").alias("tied"), pairs.cast("bigint").alias("pairs"),
        F.try_divide(F.col("concordant") + tied / 2, pairs).alias("accuracy"),
    )
