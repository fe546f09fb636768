"""Question blocks, folds, half-splits, permutations and derangements as keyed-hash jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.draws import draw_index, hash_position, keyed_hash, normal
from rosterlens.session import cut_lineage

# Fixed sizes and seed of the question cut.
EVAL_SIZE = 4096
TUNE_SIZE = 3072
BLOCK_SEED = 20260906

#: Fold codes of a plan.
EXCLUDED = -2
ALWAYS_TRAIN = -1


def stratified_sample(questions: DataFrame, size: int, seed: int, purpose: str) -> DataFrame:
    """``size`` questions spread over benchmarks in proportion to their width.

    Each benchmark gives round-half-even(size * share), at least one; an overshoot from
    rounding is trimmed by a second draw.
    """
    total = questions.agg(F.count(F.lit(1))).scalar()
    width = questions.groupBy("bench").agg(F.count(F.lit(1)).alias("width"))
    quota = width.withColumn(
        "quota", F.greatest(F.rint(size * F.col("width") / total), F.lit(1.0))
    )
    placed = hash_position(
        questions.withColumn("__h", keyed_hash(seed, purpose, F.col("question_id"))),
        ["bench"],
        "__h",
        "question_id",
        "__pos",
    )
    picked = placed.join(quota, "bench").filter(F.col("__pos") <= F.col("quota"))
    return (
        picked.withColumn("__h2", keyed_hash(seed, purpose + "-trim", F.col("question_id")))
        .orderBy("__h2", "question_id")
        .limit(size)
        .select("question_id", "bench")
    )


def question_blocks(
    questions: DataFrame, eval_size: int = EVAL_SIZE, tune_size: int = TUNE_SIZE, seed: int = BLOCK_SEED
) -> DataFrame:
    """blocks(question_id, bench, block): eval from the whole axis, tune from the rest, pool the remainder."""
    questions = cut_lineage(questions)
    ev = cut_lineage(stratified_sample(questions, eval_size, seed, "eval"))
    rest = cut_lineage(questions.join(ev, "question_id", "left_anti").select("question_id", "bench"))
    tune = cut_lineage(stratified_sample(rest, tune_size, seed, "tune"))
    pool = rest.join(tune, "question_id", "left_anti")
    return (
        ev.withColumn("block", F.lit("eval"))
        .unionByName(tune.withColumn("block", F.lit("tune")))
        .unionByName(pool.withColumn("block", F.lit("pool")))
    )


def restrict_blocks(blocks: DataFrame, keep: DataFrame) -> DataFrame:
    return blocks.join(keep, "question_id", "left_semi")


def without_benchmarks(blocks: DataFrame, dropped: Column) -> DataFrame:
    """Removes held-out questions from the fitting blocks only; eval keeps them."""
    return blocks.filter(~(F.col("block").isin("pool", "tune") & dropped))


def half_splits(questions: DataFrame, draws: int, seed: int) -> DataFrame:
    """halves(draw, question_id, half): half 1 holds floor(n/2) questions, half 2 the rest."""
    n = questions.agg(F.count(F.lit(1))).scalar()
    drawn = questions.select("question_id", draw_index(0, draws - 1).alias("draw")).withColumn(
        "__h", keyed_hash(seed, "half", F.col("draw"), F.col("question_id"))
    )
    placed = hash_position(drawn, ["draw"], "__h", "question_id", "__pos")
    return placed.select(
        "draw", "question_id", F.when(F.col("__pos") <= F.floor(n / 2), 1).otherwise(2).alias("half")
    )


def k_folds(models: DataFrame, k: int, seed: int, purpose: str = "fold") -> DataFrame:
    """folds(model_id, fold): equal-sized folds over the model axis."""
    placed = hash_position(
        models.select("model_id").withColumn("__h", keyed_hash(seed, purpose, F.col("model_id"))),
        [],
        "__h",
        "model_id",
        "__pos",
    )
    return placed.select("model_id", ((F.col("__pos") - 1) % k).cast("int").alias("fold"))


def permutations(models: DataFrame, draws: int, seed: int, own: Sequence[str] = (), source: Sequence[str] = ()) -> DataFrame:
    """perm(draw, model_id, source_id): per draw, a random one-to-one map of models onto models.

    Columns ``own`` of the model and ``source`` of its source come along, so that no copy has to be joined for them.
    """
    base = hash_position(
        models.select("model_id", *own).withColumn("__h", keyed_hash(seed, "base", F.col("model_id"))),
        [],
        "__h",
        "model_id",
    ).select("pos", "model_id", *own)
    drawn = models.select(
        F.col("model_id").alias("source_id"), *source, draw_index(1, draws).alias("draw")
    ).withColumn("__h", keyed_hash(seed, "perm", F.col("draw"), F.col("source_id")))
    placed = hash_position(drawn, ["draw"], "__h", "source_id")
    # the planner doesn't count what explode makes: without the hint it takes the copies for small and sends them all through the driver
    return placed.join(base.hint("merge"), "pos").select("draw", "model_id", "source_id", *own, *source)


def derangement(rows: DataFrame, side: str, key: str, seed: int) -> DataFrame:
    """rows(key, side, other): each row reads another row of its own side, none reads itself.

    A random order shifted by one inside each side. A side of one row has no derangement and
    comes back with ``other`` NULL.
    """
    placed = hash_position(
        rows.select(key, side).withColumn("__h", keyed_hash(seed, "derange", F.col(key))),
        [side],
        "__h",
        key,
    ).select(key, side, "pos")
    n = placed.groupBy(side).agg(F.count(F.lit(1)).alias("n"))
    nxt = placed.select(F.col(side), F.col("pos").alias("want"), F.col(key).alias("other"))
    return (
        placed.join(n, side)
        .withColumn("want", F.when(F.col("n") > 1, F.col("pos") % F.col("n") + 1))
        .join(nxt, [side, "want"], "left")
        .select(key, side, "other")
    )


def gaussian_floor(models: DataFrame, width: int, draws: int, seed: int) -> DataFrame:
    """floor(draw, model_id, dim, value): standard normal tables, one per draw."""
    return (
        models.select("model_id", draw_index(0, draws - 1).alias("draw"))
        .select("model_id", "draw", draw_index(0, width - 1).alias("dim"))
        .withColumn("value", normal(seed, "floor", F.col("draw"), F.col("model_id"), F.col("dim")))
    )


def fold_capacity(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Where the families of each size go when the largest are placed first on the least loaded fold.

    ``sizes`` is the histogram (family size, families of that size). Families of one size fill
    load levels in turn: at one level the folds below it take one family each, in order of
    their remainder. That gives, per size, at most k runs ``(size, first, last, fold cycle)``
    over the families' positions, so no family is walked one by one.
    """
    load = [0] * k
    runs: list[tuple[int, int, int, list[int]]] = []
    for size, n in sorted(sizes, reverse=True):
        level = [x // size for x in load]
        at, left = 0, n
        for lo, hi in zip(steps := sorted(set(level)), [*steps[1:], None]):
            active = sorted((f for f in range(k) if level[f] <= lo), key=lambda f: (load[f] % size, f))
            room = left if hi is None else min(left, (hi - lo) * len(active))
            if room == 0:
                continue
            runs.append((size, at, at + room - 1, active))
            for i, f in enumerate(active):
                load[f] += size * (room // len(active) + (1 if i < room % len(active) else 0))
            at, left = at + room, left - room
    return runs


def grouped_folds(models: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """plan(model_id, grp, fold): groups kept whole, largest first into the least loaded fold.

    A model without a group is its own group. Ties in size are ordered by a keyed hash; equally
    loaded folds fill lowest index first. Only the histogram of group sizes reaches the driver.
    """
    spark = models.sparkSession
    named = models.select(
        "model_id",
        F.coalesce(F.concat(F.lit("g:"), F.col(group).cast("string")), F.concat(F.lit("m:"), F.col("model_id").cast("string"))).alias("grp"),
    )
    sizes = named.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    histogram = [tuple(r) for r in sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()]
    n_groups = sum(n for _, n in histogram)
    if not 2 <= k <= n_groups:
        raise ValueError(f"k must be in [2, {n_groups}], got {k}")
    runs = spark.createDataFrame(
        fold_capacity(histogram, k), "size bigint, first bigint, last bigint, cycle array<int>"
    )
    placed = hash_position(
        sizes.withColumn("__h", keyed_hash(seed, "family", F.col("grp"))), ["size"], "__h", "grp"
    )
    assigned = placed.join(
        runs, (placed["size"] == runs["size"]) & (placed["pos"] - 1).between(runs["first"], runs["last"])
    ).select(
        "grp",
        F.get("cycle", ((F.col("pos") - 1 - F.col("first")) % F.size("cycle")).cast("int")).alias("fold"),
    )
    return named.join(assigned, "grp").select("model_id", "grp", "fold")


def split(plan: DataFrame, fold: int) -> DataFrame:
    """Adds ``side``: test for the fold's members, train for the others, NULL for excluded rows."""
    return plan.withColumn(
        "side",
        F.when(F.col("fold") == fold, "test").when(F.col("fold") != EXCLUDED, "train"),
    )


def filled_grid(cells: DataFrame, kept: DataFrame, questions: DataFrame) -> DataFrame:
    """grid(model_id, question_id, bench, correct, covered) of gated models.

    Only for models that passed a coverage floor: then the grid is at most 1/floor times the
    cells, so filling it is linear in the input.
    """
    placed = hash_position(
        questions.withColumn("__h", keyed_hash(0, "axis", F.col("question_id"))), [], "__h", "question_id", "q"
    ).select("q", "question_id", "bench")
    n = questions.agg(F.count(F.lit(1)).cast("bigint")).scalar()
    slots = kept.select("model_id").withColumn("n", n).select(
        "model_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("q")
    )
    return (
        slots.join(placed, "q")
        .join(cells.select("model_id", "question_id", "correct"), ["model_id", "question_id"], "left")
        .select(
            "model_id",
            "question_id",
            "bench",
            F.coalesce("correct", F.lit(0)).alias("correct"),
            F.col("correct").isNotNull().cast("int").alias("covered"),
        )
    )
