"""Score tables: anchoring, pooling over seeds, floors, paired bootstrap, cohorts.

results(method, task, seed, grp, value, lower_is_better, diagnostic) is the long input. These
tables grow with methods x tasks x seeds; every step is still a grouped job.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.draws import draw_index, hash_position, keyed_hash
from rosterlens.session import cut_lineage

# Fixed levels of the score tables.
MIN_HEADROOM = 1e-9
MIN_ANCHOR_GAP = 1e-12
SCORE_CLIP = 1.0
FLOOR_MARGIN = 1e-3
MIN_FIT_ARMS = 4
MIN_BOOTSTRAP_TASKS = 2
#: Units of a block whose draws are counted together, slots whose picks a task holds at a time, draws a task makes. Fixed values.
BLOCK, SLICE, PICKS = 1024, 512, 1_000_000


def headroom(value: str, chance: str, best: str, upward: bool = False) -> Column:
    """0 at chance, 1 at best; NULL without headroom (or, if ``upward``, with best below chance)."""
    span = F.col(best) - F.col(chance)
    room = span if upward else F.abs(span)
    return F.when(room > MIN_HEADROOM, F.try_divide(F.col(value) - F.col(chance), span))


# ---------------------------------------------------------------- bootstrap
def resample(units: DataFrame, keys: Sequence[str], unit: str, draws: int, seed: int, purpose: str) -> DataFrame:
    """(keys, draw, unit, times): how often each unit is drawn in each resample of its group.

    Slot i of draw b picks position hash % n, so a resample never depends on row order.
    """
    hashed = units.select(*keys, unit).distinct().withColumn(
        "__h", keyed_hash(seed, purpose, *[F.col(k) for k in keys], F.col(unit))
    )
    placed = cut_lineage(hash_position(hashed, keys, "__h", unit, "__pos").drop("__h"))
    n = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    slots = placed.join(n, list(keys)) if keys else placed.withColumn("__n", n.scalar())
    pick = keyed_hash(seed, purpose + "-slot", *[F.col(k) for k in keys], F.col("draw"), F.col("__pos")) % F.col("__n") + 1
    drawn = slots.select(*keys, "__pos", "__n", draw_index(1, draws).alias("draw")).select(*keys, "draw", pick.alias("__pos"))
    counts = drawn.groupBy(*keys, "draw", "__pos").agg(F.count(F.lit(1)).alias("times"))
    return counts.join(placed.select(*keys, unit, "__pos"), [*keys, "__pos"]).select(*keys, "draw", unit, "times")


def interval(draws: DataFrame, keys: Sequence[str], stat: str, alpha: float = 0.05) -> DataFrame:
    """Percentile interval over the draws of each group."""
    return draws.groupBy(*keys).agg(
        F.percentile(stat, alpha / 2).alias("lo"), F.percentile(stat, 1 - alpha / 2).alias("hi"), F.count(stat).alias("n_draws")
    )


def resampled_means(df: DataFrame, keys: Sequence[str], unit: str, value: str, draws: int, seed: int, purpose: str) -> DataFrame:
    """(keys, draw, stat): the mean of ``value`` in each resample of a group's units.

    The draws are those of ``resample``, but no draw is a row: a task hashes its slots' picks and sends them, packed, to the block
    of positions they fall in; a block counts them and adds up its units' values for all draws.
    """
    known = df
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    hashed = known.select(*keys, unit).distinct().withColumn("__h", keyed_hash(seed, purpose, *[F.col(k) for k in keys], F.col(unit)))
    placed = cut_lineage(hash_position(hashed, keys, "__h", unit, "__pos").drop("__h"))
    head = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose + "-slot"), *[F.col(k).cast("string") for k in keys])
    groups = cut_lineage(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).select(*keys, "__n", head.alias("__head"), F.monotonically_increasing_id().alias("__g")))
    slots = placed.join(groups, list(keys)) if keys else placed.crossJoin(groups)
    slots = cut_lineage(slots)
    block = max(1, min(BLOCK, 2**31 // draws))
    at = np.arange(draws, dtype=np.int64)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for start in range(0, len(p), SLICE):
                own = p.iloc[start : start + SLICE]
                texts = [(f"{h}|", f"|{i}") for h, i in zip(own["__head"], own["__pos"], strict=True)]
                digests = b"".join([md5(f"{h}{b}{i}".encode()).digest() for h, i in texts for b in range(1, draws + 1)])
                # the first 15 hex digits, as keyed_hash reads them
                got = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64) % np.repeat(own["__n"].to_numpy(np.int64), draws)
                group, where = np.repeat(own["__g"].to_numpy(np.int64), draws), got // block
                order = np.lexsort((where, group))
                group, where = group[order], where[order]
                code = (got % block * draws + np.tile(at, len(own))).astype("<u4")[order]
                first = np.flatnonzero((np.diff(group, prepend=-1) != 0) | (np.diff(where, prepend=-1) != 0))
                yield pd.DataFrame({"g": group[first], "block": where[first], "codes": [c.tobytes() for c in np.split(code, first[1:])]})

    def add(key: tuple, codes: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(codes) or not len(members):
            return pd.DataFrame({"g": pd.Series([], dtype="int64"), "s": pd.Series([], dtype=object), "c": pd.Series([], dtype=object)})
        w = np.bincount(np.frombuffer(b"".join(codes["codes"]), "<u4"), minlength=block * draws)
        rows = w.reshape(block, draws)[(members["__pos"].to_numpy() - 1) % block].astype(float)
        return pd.DataFrame({"g": [key[0]], "s": [members["s"].to_numpy(float) @ rows], "c": [members["c"].to_numpy(float) @ rows]})

    # slots of all groups are dealt evenly, each task about PICKS draws
    tasks = max(1, -(-slots.count() * draws // PICKS))
    picks = slots.select("__g", "__n", "__head", "__pos").repartition(tasks).mapInPandas(pick, "g long, block long, codes binary")
    values = known.groupBy(*keys, unit).agg(F.sum(F.col(value).cast("double")).alias("s"), F.count(value).cast("double").alias("c"))
    members = slots.join(values, [*keys, unit]).select(F.col("__g").alias("g"), F.floor((F.col("__pos") - 1) / block).alias("block"), "__pos", "s", "c")
    parts = picks.groupBy("g", "block").cogroup(members.groupBy("g", "block")).applyInPandas(add, "g long, s array<double>, c array<double>")
    long = parts.select("g", F.posexplode(F.arrays_zip("s", "c")).alias("draw", "x")).groupBy("g", "draw").agg(F.sum("x.s").alias("s"), F.sum("x.c").alias("c"))
    stat = long.where("c > 0").select(F.col("g").alias("__g"), (F.col("draw") + 1).alias("draw"), (F.col("s") / F.col("c")).alias("stat"))
    return stat.join(groups.select(*keys, "__g"), "__g").select(*keys, "draw", "stat")


def bootstrap_mean(df: DataFrame, keys: Sequence[str], unit: str, value: str, draws: int, seed: int) -> DataFrame:
    """(keys, mean, lo, hi, n) of a mean over units; missing values are dropped."""
    ok = df.filter(F.col(value).isNotNull())
    stat = resampled_means(cut_lineage(ok.select(*keys, unit, value)), keys, unit, value, draws, seed, "boot")
    ci = interval(stat, keys, "stat")
    mean = ok.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    out = mean.join(ci, list(keys)) if keys else mean.withColumn("__c", ci.select(F.struct("lo", "hi")).scalar()).select("*", "__c.lo", "__c.hi")
    return out.select(*keys, "mean", "lo", "hi", "n")


def cluster_interval(df: DataFrame, cluster: str, value: str, draws: int, seed: int) -> DataFrame:
    """One row (point, ci_lo, ci_hi, n_units): the mean of values when whole clusters are redrawn.

    Clusters enter through their sums and counts. The interval is widened to hold the point and
    refused with fewer than two clusters or fewer than half of the draws.
    """
    sums = df.filter(F.col(value).isNotNull()).groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    stat = (
        resample(sums, [], cluster, draws, seed, "cluster")
        .join(sums, cluster)
        .groupBy("draw")
        .agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("c"))).alias("stat"))
    )
    ci = interval(stat, [], "stat").select(F.struct("lo", "hi", "n_draws")).scalar()
    base = sums.agg((F.sum("s") / F.sum("c")).alias("point"), F.count(F.lit(1)).alias("n_units")).withColumn("ci", ci)
    ok = (F.col("n_units") >= 2) & (F.col("ci.n_draws") >= draws / 2)
    return base.select(
        "point",
        F.when(ok, F.least("ci.lo", "point")).alias("ci_lo"),
        F.when(ok, F.greatest("ci.hi", "point")).alias("ci_hi"),
        F.when(ok, F.col("n_units")).otherwise(0).alias("n_units"),
    )


# ---------------------------------------------------------------- pooling and anchoring
def pool_seeds(results: DataFrame, draws: int, seed: int) -> DataFrame:
    """Mean, sample sd, interval, n and n_missing per (method, task); one seed has no interval."""
    base = results.groupBy("method", "task").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n"),
        (F.count(F.lit(1)) - F.count("value")).alias("n_missing"),
    )
    ci = bootstrap_mean(results, ["method", "task"], "seed", "value", draws, seed).select("method", "task", "lo", "hi")
    many = F.col("n") > 1
    return base.join(ci, ["method", "task"], "left").select(
        "method", "task", "mean", F.when(many, F.col("sd")).alias("sd"), F.when(many, F.col("lo")).alias("lo"),
        F.when(many, F.col("hi")).alias("hi"), "n", "n_missing",
    )


def with_chance(df: DataFrame, per_arm: DataFrame, per_task: DataFrame) -> DataFrame:
    """Adds ``chance``: the arm's own measured null first, then the task's level."""
    own = per_arm.select("method", "task", F.col("chance").alias("__own"))
    level = per_task.select("task", F.col("chance").alias("__level"))
    return (
        df.join(own, ["method", "task"], "left").join(level, "task", "left")
        .withColumn("chance", F.coalesce("__own", "__level")).drop("__own", "__level")
    )


def anchored(value: str) -> Column:
    """(metric - chance) / (best - chance), higher is better; NULL when chance is at or past the best."""
    best = F.when(F.col("lower_is_better"), 0.0).otherwise(1.0)
    span = F.when(F.col("lower_is_better"), F.col("chance")).otherwise(1.0 - F.col("chance"))
    return F.when(span > MIN_ANCHOR_GAP, F.try_divide(F.col(value) - F.col("chance"), best - F.col("chance")))


def clip(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(-SCORE_CLIP), F.least(F.lit(SCORE_CLIP), x)))


def competence_delta(df: DataFrame, keys: Sequence[str], arm: str) -> DataFrame:
    """Adds ``delta``: the score minus the reference arm's mean score on the same keys."""
    base = df.filter(F.col("method") == arm).groupBy(*keys).agg(F.avg("s").alias("__base"))
    return df.join(base, list(keys), "left").withColumn("delta", F.col("s") - F.col("__base")).drop("__base")


def score_seeds(results: DataFrame, per_arm: DataFrame, per_task: DataFrame, arm: str, factor: float) -> DataFrame:
    """Every (method, task, seed) anchored, clipped, compared with the baseline and flagged."""
    df = with_chance(results, per_arm, per_task).withColumn("unclipped", anchored("value"))
    df = df.withColumn("s", clip(F.col("unclipped")))
    return competence_delta(df, ["task", "seed"], arm).withColumn("diverged", (F.abs("unclipped") > factor).cast("int"))


def score_frame(seeds: DataFrame, weights: DataFrame, arm: str) -> DataFrame:
    """(method, task, grp, s, w, above_chance, unclipped, worst_seed, n_seeds, delta) from scored seeds."""
    per = seeds.groupBy("method", "task", "grp", "diagnostic").agg(
        F.avg("s").alias("s"),
        F.avg("unclipped").alias("unclipped"),
        F.max_by("unclipped", F.struct(F.abs("unclipped"), -F.col("seed"))).alias("worst_seed"),
        F.count("s").alias("n_seeds"),
    )
    per = per.join(weights, "task", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    return competence_delta(per, ["task"], arm).withColumn("above_chance", (F.col("s") > 0).cast("int"))


def cluster_weights(clusters: DataFrame) -> DataFrame:
    """(task, w): 1 / cluster size of clusters(cluster, task)."""
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return clusters.join(size, "cluster").select("task", (F.lit(1.0) / F.col("n")).alias("w"))


def group_scores(frame: DataFrame) -> DataFrame:
    """Weighted mean score per (method, group) with the counts that say what it averages.

    The common tasks of a group are those every arm with any score in it has a score on.
    """
    d = frame.filter(~F.col("diagnostic"))
    kept = d.filter(F.col("s").isNotNull())
    arms = kept.groupBy("grp").agg(F.countDistinct("method").alias("arms"))
    common = (
        kept.groupBy("grp", "task").agg(F.countDistinct("method").alias("k")).join(arms, "grp")
        .filter(F.col("k") == F.col("arms")).select("grp", "task", F.lit(1).alias("shared"))
    )
    x = d.join(common, ["grp", "task"], "left")
    has, both = F.col("s").isNotNull(), F.col("s").isNotNull() & (F.col("shared") == 1)

    def mean(mask: Column) -> Column:
        return F.try_divide(F.sum(F.when(mask, F.col("w") * F.col("s"))), F.sum(F.when(mask, F.col("w"))))

    def names(mask: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(mask, F.col("task")))), "|")

    return x.groupBy("method", "grp").agg(
        mean(has).alias("score"),
        F.count_if(has).alias("n_tasks"),
        F.sum(F.when(has, F.col("w"))).alias("eff_tasks"),
        mean(both).alias("score_common"),
        F.count_if(both).alias("n_tasks_common"),
        F.count_if(has & (F.col("above_chance") == 1)).alias("n_above"),
        F.coalesce(F.bool_or(has & (F.col("above_chance") == 1)), F.lit(False)).cast("int").alias("any_above"),
        F.count_if(~has).alias("n_dropped"),
        names(has).alias("tasks_scored"),
        names(~has).alias("tasks_dropped"),
    ).filter("n_tasks > 0")


def cohorts(frame: DataFrame) -> DataFrame:
    """(tasks, methods, n_methods): arms that carry a score on exactly the same tasks."""
    sets = frame.filter(~F.col("diagnostic") & F.col("s").isNotNull()).groupBy("method").agg(
        F.array_join(F.array_sort(F.collect_set("task")), "|").alias("tasks")
    )
    return sets.groupBy("tasks").agg(
        F.array_join(F.array_sort(F.collect_list("method")), "|").alias("methods"), F.count(F.lit(1)).alias("n_methods")
    )


def complete_panel(frame: DataFrame) -> DataFrame:
    """(task, method, s, w) on the tasks every arm scored."""
    d = frame.filter(~F.col("diagnostic") & F.col("s").isNotNull()).select("task", "method", "s", "w")
    d = cut_lineage(d)
    arms = d.agg(F.countDistinct("method")).scalar()
    full = d.groupBy("task").agg(F.countDistinct("method").alias("k")).filter(F.col("k") == arms)
    return d.join(full, "task", "left_semi")


def paired_bootstrap(frame: DataFrame, draws: int, seed: int) -> DataFrame:
    """(method, score, lcb, ucb, p_top1, n_tasks): tasks resampled once per draw for all arms alike."""
    panel = cut_lineage(complete_panel(frame))
    times = resample(panel, [], "task", draws, seed, "paired")
    stat = (
        panel.join(times, "task").groupBy("draw", "method")
        .agg((F.sum(F.col("times") * F.col("w") * F.col("s")) / F.sum(F.col("times") * F.col("w"))).alias("stat"))
        .withColumn("stat", F.round("stat", 12))
    )
    stat = cut_lineage(stat)
    lead = stat.groupBy("draw").agg(F.max("stat").alias("top"))
    ties = stat.join(lead, "draw").filter(F.col("stat") == F.col("top")).groupBy("draw").agg(F.count(F.lit(1)).alias("leaders"))
    won = stat.join(lead, "draw").join(ties, "draw").groupBy("method").agg(
        F.avg(F.when(F.col("stat") == F.col("top"), F.lit(1.0) / F.col("leaders")).otherwise(0.0)).alias("p_top1")
    )
    ci = interval(stat, ["method"], "stat").select("method", F.col("lo").alias("lcb"), F.col("hi").alias("ucb"))
    point = panel.groupBy("method").agg(
        (F.sum(F.col("w") * F.col("s")) / F.sum("w")).alias("score"), F.count(F.lit(1)).alias("n_tasks")
    )
    return point.join(ci, "method").join(won, "method").filter(F.col("n_tasks") >= MIN_BOOTSTRAP_TASKS)


def maximal_set(boot: DataFrame) -> DataFrame:
    """Arms whose upper bound reaches the best lower bound."""
    boot = cut_lineage(boot)
    return boot.filter(F.col("ucb") >= boot.agg(F.max("lcb")).scalar())


def residual_against_null(frame: DataFrame) -> DataFrame:
    """Per task: the score minus the reference arm's score."""
    d = frame.filter(~F.col("diagnostic") & F.col("s").isNotNull())
    return d.select("method", "task", "grp", "w", F.col("delta").alias("s"), (F.col("delta") > 0).cast("int").alias("above_chance"))


def residual_against_fit(frame: DataFrame, competence_task: str) -> DataFrame:
    """Per task: what a straight line on the arms' competence score leaves.

    The line is fitted over arms above the clip floor; a task with fewer than four of them, or
    with no spread, is skipped.
    """
    d = frame.filter(~F.col("diagnostic") & F.col("s").isNotNull())
    comp = d.filter(F.col("task") == competence_task).select("method", F.col("s").alias("x"))
    j = d.filter(F.col("task") != competence_task).join(comp, "method", "left")
    use = F.col("x").isNotNull() & (F.col("x") > -SCORE_CLIP + FLOOR_MARGIN)
    x, y = F.when(use, F.col("x")), F.when(use, F.col("s"))
    line = j.groupBy("task").agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(x).alias("k"), F.stddev_samp(x).alias("sx")
    ).filter((F.col("k") >= MIN_FIT_ARMS) & (F.col("sx") >= MIN_ANCHOR_GAP))
    res = F.col("s") - (F.col("intercept") + F.col("slope") * F.col("x"))
    return j.join(line, "task").select("method", "task", "grp", "w", res.alias("s"), (res > 0).cast("int").alias("above_chance"))


# ---------------------------------------------------------------- floors and runs
def holdout_rows(main: DataFrame, held: DataFrame) -> DataFrame:
    """The main rows, the held-out group rows, and the mean over the groups. rows(method, task, grp, s, dim)."""
    mean = held.groupBy("method", "task").agg(
        F.avg("s").alias("s"), F.min("s").alias("ci_lo"), F.max("s").alias("ci_hi"),
        F.countDistinct("grp").alias("n_units"), F.min_by("dim", "grp").alias("dim"),
    ).withColumn("grp", F.lit("mean"))
    return main.unionByName(held, allowMissingColumns=True).unionByName(mean, allowMissingColumns=True)


def floor_spread(per_draw: DataFrame) -> DataFrame:
    """(method, task, grp, floor_s, draws, floor_sd) over the draws of a random floor."""
    return per_draw.groupBy("method", "task", "grp").agg(
        F.avg("s").alias("floor_s"), F.count("s").alias("floor_draws"), F.stddev_samp("s").alias("floor_sd")
    )


def attach_floor(rows: DataFrame, floors: DataFrame) -> DataFrame:
    """Adds the floor of the closest width (ties to the smaller) and the gap to it.

    A floor of several draws is preferred over the run's own single draw. The widths are the
    distinct floor arms, a list that is kept per row as one array.
    """
    width = F.regexp_extract("method", "^null_random([0-9]+)$", 1).try_cast("int")
    known = rows.select(width.alias("w")).unionByName(floors.select(width.alias("w"))).filter("w is not null").distinct()
    widths = known.agg(F.array_sort(F.collect_list("w"))).scalar()
    out = rows.withColumn("__ws", widths)
    near = F.array_min(F.transform("__ws", lambda w: F.struct(F.abs(w - F.coalesce(F.col("dim"), F.get("__ws", F.lit(0)))).alias("d"), w.alias("w"))))["w"]
    out = out.withColumn("floor_arm", F.concat(F.lit("null_random"), near.cast("string"))).drop("__ws")
    multi = floors.withColumnsRenamed({"method": "floor_arm"})
    single = rows.filter(width.isNotNull()).select(F.col("method").alias("floor_arm"), "task", "grp", F.col("s").alias("single"))
    out = out.join(multi, ["floor_arm", "task", "grp"], "left").join(single, ["floor_arm", "task", "grp"], "left")
    many = F.col("floor_s").isNotNull()
    return (
        out.withColumn("floor_draws", F.when(many, F.col("floor_draws")).when(F.col("single").isNotNull(), 1))
        .withColumn("floor_sd", F.when(many, F.col("floor_sd")))
        .withColumn("floor_s", F.coalesce("floor_s", "single"))
        .drop("single")
        .withColumn("s_over_floor", F.col("s") - F.col("floor_s"))
    )


def summary(scores: DataFrame) -> DataFrame:
    """Mean over runs per (method, task, grp)."""
    return scores.groupBy("method", "task", "grp").agg(
        F.avg("s").alias("s"), F.avg("floor_s").alias("floor_s"), F.avg("s_over_floor").alias("s_over_floor"),
        F.stddev_samp("s_over_floor").alias("s_over_floor_sd"), F.countDistinct("run").alias("n_runs"),
        F.min("floor_arm").alias("floor_arm"),
    )


def agreed(value: str) -> Column:
    """The one value all rows share, else NULL."""
    return F.when(F.countDistinct(value) == 1, F.max(value))


def width_fence(diagnostics: DataFrame, policy: DataFrame) -> DataFrame:
    """Arms whose fitted width is not the asked one, with the reason.

    policy(method, declared) says "run", "input" or a fixed width.
    """
    d = diagnostics.join(policy, "method", "left")
    declared = F.coalesce("declared", F.lit("run"))
    reason = (
        F.when(F.col("run_dim").isNull(), None)
        .when(F.col("emb_dim").isNull(), "width_not_recorded")
        .when(F.col("emb_dim") == F.col("run_dim"), None)
        .when(declared == "input", "declared_input_width")
        .when(declared != "run", "declared_fixed_width")
        .when(F.col("emb_dim") < F.col("run_dim"), "saturated_below_request")
        .otherwise("wider_than_request")
    )
    return d.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(
        "method", "seed", "run_dim", "emb_dim", (F.col("emb_dim") - F.col("run_dim")).alias("delta"),
        declared.alias("declared_width"), (declared != "run").cast("int").alias("declared_fixed"), "reason",
    )
