"""The two-parameter response model fitted by alternating Newton steps on the cell table.

Objective: mean cross-entropy over the cells + 1e-3 (mean theta^2 + mean a^2). A step for the
models and a step for the questions are each one join and one aggregate of gradient and
curvature sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.draws import uniform
from rosterlens.functions.scalars import sigmoid
from rosterlens.session import cut_lineage

PENALTY = 1e-3
#: Largest step of a coordinate in one iteration.
MAX_STEP = 1.0
#: Distinct abilities that a question meets at a time.
ABILITY_BLOCK = 1024


@dataclass(frozen=True)
class Fit2PL:
    theta: DataFrame  # (model_id, theta)
    items: DataFrame  # (question_id, a, b)
    moved: float = 0.0  # largest change in the last round
    converged: bool = True


def _clip(x: Column) -> Column:
    return F.greatest(F.lit(-MAX_STEP), F.least(F.lit(MAX_STEP), x))


def ability_step(cells: DataFrame, theta: DataFrame, items: DataFrame, scale: float) -> DataFrame:
    """One Newton step of every model's ability with the items fixed; ``scale`` = penalty weight per model."""
    z = F.col("a") * F.col("theta") + F.col("b")
    joined = cells.join(items, "question_id").join(theta, "model_id").withColumn("p", sigmoid(z))
    sums = joined.groupBy("model_id").agg(
        F.first("theta").alias("theta"),
        F.sum(F.col("a") * (F.col("correct") - F.col("p"))).alias("g"),
        F.sum(F.col("a") * F.col("a") * F.col("p") * (1 - F.col("p"))).alias("h"),
    )
    step = (F.col("g") - scale * F.col("theta")) / (F.col("h") + scale)
    return sums.select("model_id", (F.col("theta") + _clip(step)).alias("theta"))


def item_step(cells: DataFrame, theta: DataFrame, items: DataFrame, scale: float) -> DataFrame:
    """One Newton step of every question's (a, b) with the abilities fixed."""
    p = sigmoid(F.col("a") * F.col("theta") + F.col("b"))
    t, w, r = F.col("theta"), F.col("p") * (1 - F.col("p")), F.col("correct") - F.col("p")
    joined = cells.join(theta, "model_id").join(items, "question_id").withColumn("p", p)
    s = joined.groupBy("question_id").agg(
        F.first("a").alias("a"), F.first("b").alias("b"),
        F.sum(t * r).alias("ga"), F.sum(r).alias("gb"),
        F.sum(t * t * w).alias("haa"), F.sum(t * w).alias("hab"), F.sum(w).alias("hbb"),
    )
    ga = F.col("ga") - scale * F.col("a")
    haa, hab, hbb = F.col("haa") + scale, F.col("hab"), F.col("hbb") + 1e-6
    det = haa * hbb - hab * hab
    return s.select(
        "question_id",
        (F.col("a") + _clip((hbb * ga - hab * F.col("gb")) / det)).alias("a"),
        (F.col("b") + _clip((haa * F.col("gb") - hab * ga) / det)).alias("b"),
    )


def fit_2pl(cells: DataFrame, seed: int = 0, rounds: int = 12, tolerance: float = 1e-2) -> Fit2PL:
    """Alternating Newton fit; the start is a small hashed ability plus the model's mean, a = 1.

    Ends when neither an ability nor an item moves by more than ``tolerance``, or after ``rounds`` rounds; the fit
    says how far the last round moved and whether that was within the tolerance.
    """
    c = cut_lineage(cells.select("model_id", "question_id", "correct"))
    counts = c.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("model_id").alias("m"), F.countDistinct("question_id").alias("q")).first()
    # the mean-loss objective times the number of cells: 2 * penalty * n / axis length per coordinate
    theta_scale, item_scale = 2 * PENALTY * counts["n"] / counts["m"], 2 * PENALTY * counts["n"] / counts["q"]
    theta = cut_lineage(
        c.groupBy("model_id").agg((4 * (F.avg("correct") - 0.5)).alias("m")).select(
            "model_id", (F.col("m") + 0.01 * uniform(seed, "irt", F.col("model_id"))).alias("theta")
        )
    )
    items = c.groupBy("question_id").agg(F.avg("correct").alias("m")).select(
        "question_id", F.lit(1.0).alias("a"), F.ln((F.col("m") + 0.01) / (1.01 - F.col("m"))).alias("b")
    )
    items = cut_lineage(items)
    moved = float("inf")
    for _ in range(rounds):
        new_items = cut_lineage(item_step(c, theta, items, item_scale))
        new_theta = cut_lineage(ability_step(c, theta, new_items, theta_scale))
        moved = max(
            _largest_change(items, new_items, "question_id", ("a", "b")), _largest_change(theta, new_theta, "model_id", ("theta",))
        )
        items, theta = new_items, new_theta
        if moved <= tolerance:
            break
    return Fit2PL(theta, items, moved, moved <= tolerance)


def objective(cells: DataFrame, fit: Fit2PL) -> DataFrame:
    """One row (loss, n): the penalised mean cross-entropy of a fit."""
    z = F.col("a") * F.col("theta") + F.col("b")
    ce = F.greatest(z, F.lit(0.0)) - F.col("correct") * z + F.log1p(F.exp(-F.abs(z)))
    data = cells.join(fit.theta, "model_id").join(fit.items, "question_id").agg(F.avg(ce).alias("ce"), F.count(F.lit(1)).alias("n"))
    t2 = fit.theta.agg(F.avg(F.col("theta") * F.col("theta"))).scalar()
    a2 = fit.items.agg(F.avg(F.col("a") * F.col("a"))).scalar()
    return data.select((F.col("ce") + PENALTY * (t2 + a2)).alias("loss"), "n")


def _largest_change(old: DataFrame, new: DataFrame, key: str, columns: tuple[str, ...]) -> float:
    both = old.toDF(key, *(f"{c}_old" for c in columns)).join(new.toDF(key, *(f"{c}_new" for c in columns)), key)
    moved = F.array_max(F.array(*(F.abs(F.col(f"{c}_old") - F.col(f"{c}_new")) for c in columns)))
    return both.agg(F.max(moved).alias("m")).first().m or 0.0


def fold_in_ability(cells: DataFrame, items: DataFrame, rounds: int = 50, scale: float = PENALTY, tolerance: float = 1e-6) -> DataFrame:
    """Abilities of models the items were not fitted on, the items frozen; all models at once.

    Ends when no ability moves by more than ``tolerance``, or after ``rounds`` steps.
    """
    c = cut_lineage(cells.select("model_id", "question_id", "correct"))
    theta = c.select("model_id").distinct().withColumn("theta", F.lit(0.0))
    for _ in range(rounds):
        new = cut_lineage(ability_step(c, theta, items, scale))
        done = _largest_change(theta, new, "model_id", ("theta",)) <= tolerance
        theta = new
        if done:
            break
    return theta


def test_information(cells: DataFrame, fit: Fit2PL) -> DataFrame:
    """(question_id, score): sum over the fitted models of a^2 p (1 - p).

    Every model counts for every question, also where its cell is missing. Equal abilities are counted
    first; the distinct ones are dealt into blocks, and each question meets one block at a time, so no
    row holds them all. The blocks' sums are then added.
    """
    grid = fit.theta.groupBy(F.col("theta").alias("t")).agg(F.count(F.lit(1)).alias("w"))
    n_blocks = -(-grid.count() // ABILITY_BLOCK) or 1
    blocks = grid.groupBy(F.pmod(F.xxhash64("t"), F.lit(n_blocks)).alias("block")).agg(F.collect_list(F.struct("t", "w")).alias("g"))
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    items = fit.items.select("*", every.alias("block")).join(blocks, "block")
    total = F.aggregate(
        "g", F.lit(0.0),
        lambda s, v: s + v["w"] * sigmoid(F.col("a") * v["t"] + F.col("b")) * (1 - sigmoid(F.col("a") * v["t"] + F.col("b"))),
    )
    parts = items.select("question_id", (F.col("a") * F.col("a") * total).alias("part"))
    return parts.groupBy("question_id").agg(F.sum("part").alias("score"))
