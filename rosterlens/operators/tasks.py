"""Evaluation queries: can the embedding predict a property of the models out of fold?

A task is a function of ``Bench`` (the tables of one scoring run) that returns a DataFrame with
one row of metrics. Tasks register themselves; a task that fails becomes an error row and one
whose input is absent becomes a note row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from rosterlens.functions import ranks as R
from rosterlens.functions.draws import hash_position, keyed_hash
from rosterlens.operators import intervals
from rosterlens.operators.heads import oof_logistic, oof_ridge
from rosterlens.operators.splits import grouped_folds, k_folds, permutations
from rosterlens.session import cut_lineage, staged

# Fixed sizes of the task battery.
MIN_FIT, MIN_SCORE = 8, 4
MIN_FAMILY_MEMBERS = 3
MIN_FAMILIES = 3
#: Permuted copies of a label behind a null, and of a bank behind a transfer's null.
LABEL_PERMUTATIONS, TRANSFER_PERMUTATIONS = 200, 40


@dataclass
class Bench:
    """The tables of one scoring run, all keyed by model_id / question_id."""

    embedding: DataFrame  # (model_id, vec)
    cells: DataFrame  # (model_id, question_id, bench, acc, correct)
    models: DataFrame  # (model_id, family, params_b, vram_gb, is_chat)
    labels: DataFrame | Callable[[], DataFrame] | None = None  # (board, model_id, value)
    folds: int = 5
    seed: int = 7
    permutations: int = LABEL_PERMUTATIONS
    transfer_permutations: int = TRANSFER_PERMUTATIONS
    draws: int = intervals.DRAWS
    cache: dict = field(default_factory=dict)

    def part(self, name: str) -> DataFrame:
        """An input that only some tasks read; one given as a function is made and written at its first use."""
        if callable(self.cache[name]):
            self.cache[name] = cut_lineage(self.cache[name]())
        return self.cache[name]

    def published(self) -> DataFrame:
        """The label columns, likewise."""
        if callable(self.labels):
            self.labels = cut_lineage(self.labels())
        return self.labels

    def keep(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A sub-result several tasks read, written once."""
        if name not in self.cache:
            self.cache[name] = cut_lineage(make())
        return self.cache[name]

    def fold_plan(self) -> DataFrame:
        return self.keep("folds", lambda: k_folds(self.models, self.folds, self.seed))

    def accuracy(self) -> DataFrame:
        return self.keep("accuracy", lambda: self.cells.groupBy("model_id").agg(F.avg("acc").alias("y")))

    def benchmark_scores(self) -> DataFrame:
        return self.keep("bench", lambda: self.cells.groupBy("model_id", "bench").agg(F.avg("acc").alias("score")))

    def decoded(self) -> DataFrame:
        """(model_id, question_id, predicted): every cell decoded from the embedding alone."""
        return self.keep("decoded", lambda: decode_cells(self))


Task = Callable[[Bench], DataFrame]

Scheme = Callable[[DataFrame, DataFrame, int, int], DataFrame]
#: Fold schemes by name: plan(model_id, fold) of (rows, models, folds, seed).
SCHEMES: dict[str, Scheme] = {}


def scheme(name: str) -> Callable[[Scheme], Scheme]:
    """Register a fold scheme."""

    def add(fn: Scheme) -> Scheme:
        SCHEMES[name] = fn
        return fn

    return add


@scheme("models")
def _by_model(rows: DataFrame, models: DataFrame, folds: int, seed: int) -> DataFrame:
    return k_folds(rows, folds, seed)


@scheme("family")
def _by_family(rows: DataFrame, models: DataFrame, folds: int, seed: int) -> DataFrame:
    """Families kept whole; no more folds than families."""
    named = rows.select("model_id").join(models.select("model_id", "family"), "model_id")
    groups = F.coalesce(F.col("family").cast("string"), F.concat(F.lit("m:"), F.col("model_id").cast("string")))
    return grouped_folds(named, "family", min(folds, named.select(groups).distinct().count()), seed)


def fold_plan(b: Bench, name: str, rows: DataFrame, folds: int | None = None) -> DataFrame:
    if name not in SCHEMES:
        raise ValueError(f"unknown fold scheme {name!r}; there are {sorted(SCHEMES)}")
    return SCHEMES[name](rows, b.models, folds or b.folds, b.seed)


@dataclass(frozen=True)
class TaskSpec:
    name: str
    primary: str
    run: Task
    group: str
    lower_is_better: bool = False
    diagnostic: bool = False
    source: str = ""  # where its label comes from: boards, traits, measures, cards; "" for what every run has
    label: str = ""  # the column there
    floor: int = MIN_FIT + MIN_SCORE
    folds: str = "models"


TASKS: dict[str, TaskSpec] = {}


def task(name: str, primary: str, group: str, lower_is_better: bool = False, diagnostic: bool = False) -> Callable[[Task], Task]:
    def add(fn: Task) -> Task:
        TASKS[name] = TaskSpec(name, primary, fn, group, lower_is_better, diagnostic)
        return fn

    return add


def absent(bench: Bench, primary: str, note: str) -> DataFrame:
    """The row of a task whose input is not there."""
    return bench.embedding.agg(F.lit(None).cast("double").alias(primary), F.lit(note).alias("note"))


# ---------------------------------------------------------------- heads over targets
def wide_target(long: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """((model_id, y array), axis(pos, key)): one target per value of ``key``; a missing one is 0.

    Targets are numbered by a hashed order. Each task scatters its models' values into arrays, so
    the axis is neither collected nor spelled out in the plan.
    """
    axis = cut_lineage(
        hash_position(long.select(key).distinct().withColumn("__h", keyed_hash(0, "axis", F.col(key))), [], "__h", key).select("pos", key)
    )
    n = axis.agg(F.count(F.lit(1))).scalar()
    got = (
        long.join(axis, key).groupBy("model_id").agg(F.collect_list(F.struct("pos", F.col(value).cast("double").alias("v"))).alias("c"))
        .select("model_id", F.col("c.pos").alias("pos"), F.col("c.v").alias("v")).withColumn("n", n)
    )

    def scatter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for pos, v, size in zip(p["pos"], p["v"], p["n"]):
                y = np.zeros(size)
                y[np.asarray(pos) - 1] = v
                out.append(y)
            yield pd.DataFrame({"model_id": p["model_id"], "y": out})

    return got.mapInPandas(scatter, f"model_id {dict(long.dtypes)['model_id']}, y array<double>"), axis


def long_prediction(out: DataFrame, axis: DataFrame, key: str) -> DataFrame:
    """(model_id, key, predicted) of an out-of-fold result with one target per axis entry."""
    flat = out.select("model_id", F.posexplode("predicted").alias("p", "predicted")).withColumn("pos", F.col("p") + 1)
    return flat.join(axis, "pos").select("model_id", key, "predicted")


def rows_for(bench: Bench, targets: DataFrame, folds: DataFrame | None = None) -> DataFrame:
    plan = bench.fold_plan() if folds is None else folds
    return (
        bench.embedding.select("model_id", F.col("vec").alias("x"))
        .join(targets, "model_id")
        .join(plan.select("model_id", "fold"), "model_id")
    )


def decode_cells(bench: Bench) -> DataFrame:
    y, axis = wide_target(bench.cells, "question_id", "acc")
    return long_prediction(oof_ridge(rows_for(bench, y)), axis, "question_id")


def permuted_targets(y: DataFrame, draws: int, seed: int) -> DataFrame:
    """(model_id, y array): the true target first, then ``draws`` permuted copies of it."""
    perm = permutations(y, draws, seed)
    source = y.select(F.col("model_id").alias("source_id"), F.col("y").alias("v"))
    copies = perm.join(source, "source_id").select("model_id", "draw", "v")
    both = copies.unionByName(y.select("model_id", F.lit(0).alias("draw"), F.col("y").alias("v")))
    return both.groupBy("model_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("draw", "v"))), lambda s: s["v"]).alias("y")
    )


def with_interval(b: Bench, row: DataFrame, rows: DataFrame, statistic: str | Callable[[DataFrame], DataFrame], point: str, units: tuple[str, ...] = ("model_id",), **more) -> DataFrame:
    """``row`` with ci_lo, ci_hi and n_units of ``statistic`` over rows(units, y, p)."""
    row = cut_lineage(row)
    value = row.select(point).first()
    ci = intervals.interval(rows, statistic, None if value is None else value[0], units, b.draws, b.seed, **more)
    got = ci.first()
    return row.select(
        "*", F.lit(got["ci_lo"]).cast("double").alias("ci_lo"), F.lit(got["ci_hi"]).cast("double").alias("ci_hi"), F.lit(got["n_units"]).cast("bigint").alias("n_units")
    )


def scalar_transfer(b: Bench, y: DataFrame, primary: str = "r2", grouped: str | None = None, competence: bool = False) -> DataFrame:
    """One row: R2 and Spearman of an out-of-fold ridge, the mean of the primary over permuted targets, and its interval over models.

    y(model_id, y). The permuted copies ride along as extra targets of the same fit. ``competence`` adds the primary of a head
    that sees the model's accuracy only: what the label says beyond how good a model is.
    """
    y = cut_lineage(y.filter(F.col("y").isNotNull()).join(b.embedding.select("model_id"), "model_id", "left_semi"))
    n = y.count()
    if n < MIN_FIT + MIN_SCORE:
        return absent(b, primary, f"{n} labelled models, {MIN_FIT + MIN_SCORE} needed")
    plan = cut_lineage(fold_plan(b, grouped or "models", y, min(b.folds, n)).select("model_id", "fold"))
    rows = rows_for(b, permuted_targets(y, b.permutations, b.seed), plan)
    out = oof_ridge(rows, per_target=True)
    long = cut_lineage(
        out.select("model_id", F.posexplode(F.arrays_zip("y", "predicted")).alias("draw", "c")).select(
            "model_id", "draw", F.col("c.y").alias("y"), F.round("c.predicted", 12).alias("p")
        )
    )
    r2 = R.r2_pooled(long, ["draw"], [], "y", "p").select("draw", "r2")
    # permuted copies hold the same values, so one copy's ranks serve all
    ranks = cut_lineage(R.value_ranks(long.where("draw = 0").select("y"), [], "y", "__ra"))
    rho = R.spearman(long, ["draw"], "y", "p", ranks=ranks).select("draw", "spearman")
    both = r2.join(rho, "draw")
    true, null = F.col("draw") == 0, F.col("draw") > 0
    row = both.agg(
        F.max(F.when(true, F.col("r2"))).alias("r2"),
        F.max(F.when(true, F.col("spearman"))).alias("spearman"),
        F.avg(F.when(null, F.col(primary))).alias("permuted_null"),
        F.lit(n).cast("bigint").alias("n_labelled"),
        F.lit(int(grouped is not None)).alias("grouped_cv"),
        F.lit(None).cast("string").alias("note"),
    )
    if competence:
        alone = b.accuracy().select("model_id", F.array("y").alias("x")).join(y.select("model_id", F.array("y").alias("y")), "model_id").join(plan, "model_id")
        one = oof_ridge(alone).select(F.col("y")[0].alias("y"), F.round(F.col("predicted")[0], 12).alias("p"))
        stat = R.r2_pooled(one, [], [], "y", "p").select("r2") if primary == "r2" else R.spearman(one, [], "y", "p").select("spearman")
        row = row.withColumn("competence_only", stat.scalar())
    return with_interval(b, row, long.where("draw = 0").select("model_id", "y", "p"), primary, primary)


# ---------------------------------------------------------------- structural tasks
@task("score_regression", "r2", "structural")
def score_regression(b: Bench) -> DataFrame:
    return scalar_transfer(b, b.accuracy())


@task("model_size_regression", "r2", "structural")
def model_size_regression(b: Bench) -> DataFrame:
    y = b.models.select("model_id", F.when(F.col("params_b") > 0, F.log10("params_b")).alias("y"))
    return scalar_transfer(b, y)


def tilt(b: Bench, matched: Column) -> DataFrame:
    """Mean of the matched benchmarks minus the mean of the rest, per model."""
    s = b.benchmark_scores()
    return s.groupBy("model_id").agg(
        (F.avg(F.when(matched, F.col("score"))) - F.avg(F.when(~matched, F.col("score")))).alias("y")
    )


@task("reasoning_style", "r2", "structural")
def reasoning_style(b: Bench) -> DataFrame:
    matched = F.col("bench").isin(*b.cache.get("reasoning_benches", ("ECONOMY", "LARGE")))
    n = b.benchmark_scores().select("bench").distinct().filter(matched).count()
    if n < 2:
        return absent(b, "r2", f"{n} benchmarks match, 2 needed")
    return scalar_transfer(b, tilt(b, matched))


@task("ranking", "ndcg", "structural")
def ranking(b: Bench) -> DataFrame:
    """Leave-one-benchmark-out: the target is the mean of the other benchmarks, read against the held-out one."""
    s = b.benchmark_scores()
    tot = s.groupBy("model_id").agg(F.sum("score").alias("t"), F.count(F.lit(1)).alias("k"))
    rest = s.join(tot, "model_id").withColumn("rest", (F.col("t") - F.col("score")) / (F.col("k") - 1))
    if s.select("bench").distinct().count() < 2:
        return absent(b, "ndcg", "one benchmark: nothing is held out")
    scored = _per_benchmark(b, rest, "rest").join(s, ["model_id", "bench"])
    keys = ["draw", "bench"]
    nd = R.ndcg(scored, keys, "score", "predicted", "model_id", 10)
    rho = R.spearman(scored, keys, "score", "predicted")
    return _over_benchmarks(b, cut_lineage(nd.join(rho, keys)), "ndcg", ["ndcg", "spearman"])


def _per_benchmark(b: Bench, long: DataFrame, value: str, per_target: bool = True) -> DataFrame:
    """(draw, model_id, bench, predicted): draw 0 from the embedding, the others from a bank in which models' vectors are permuted."""
    placed, axis = _per_model(b, long, value, per_target)
    flat = placed.select("draw", "model_id", F.posexplode("predicted").alias("p", "predicted")).withColumn("pos", F.col("p") + 1)
    return cut_lineage(flat.join(axis, "pos").select("draw", "model_id", "bench", "predicted"))


def _per_model(b: Bench, long: DataFrame, value: str, per_target: bool = True) -> tuple[DataFrame, DataFrame]:
    """((draw, model_id, predicted array), axis(pos, bench)): the same with one array for each draw and model, in the order of the axis."""
    y, axis = wide_target(long, "bench", value)
    axis = cut_lineage(axis)
    width = axis.count()
    perm = permutations(b.embedding, max(b.transfer_permutations, 1), b.seed).select("draw", "model_id", "source_id")
    perm = cut_lineage(perm if b.transfer_permutations else perm.limit(0))
    # a permuted bank with the true targets is the true bank with permuted targets: row i has i's vector and its taker's target
    own = y.join(b.embedding.select("model_id"), "model_id", "left_semi").select("model_id", F.lit(0).alias("draw"), "y")
    taken = perm.join(y, "model_id").select(F.col("source_id").alias("model_id"), "draw", "y")
    held = own.unionByName(taken).groupBy("model_id").agg(F.array_sort(F.collect_list(F.struct("draw", "y"))).alias("c"))
    full = held.where(F.size("c") == b.transfer_permutations + 1).select("model_id", F.flatten(F.transform("c", lambda x: x["y"])).alias("y"))
    out = oof_ridge(rows_for(b, full), per_target=per_target)
    draw = F.explode(F.sequence(F.lit(0), F.lit(b.transfer_permutations))).alias("draw")
    out = out.select("model_id", draw, "predicted").withColumn("predicted", F.slice("predicted", F.col("draw") * width + 1, F.lit(width)))
    back = perm.select("draw", F.col("source_id").alias("model_id"), F.col("model_id").alias("taker"))
    placed = out.join(back, ["draw", "model_id"], "left")
    who = F.when(F.col("draw") == 0, F.col("model_id")).otherwise(F.col("taker"))
    return placed.select("draw", who.alias("model_id"), F.transform("predicted", lambda x: F.round(x, 12)).alias("predicted")), axis


def _over_benchmarks(b: Bench, per: DataFrame, primary: str, metrics: list[str]) -> DataFrame:
    """Means over benchmarks of per(draw, bench, metrics), the permuted null of the primary and its interval over benchmarks."""
    true = per.where("draw = 0")
    null = per.where("draw > 0").groupBy("draw").agg(F.avg(primary).alias("m")).agg(F.avg("m"))
    row = true.agg(*[F.avg(m).alias(m) for m in metrics], null.scalar().alias("permuted_null"), F.count(primary).alias("n_benchmarks"))
    return with_interval(b, row, true.where(F.col(primary).isNotNull()).select("bench", F.col(primary).alias("y")), "mean", primary, ("bench",))


@task("cross_benchmark", "spearman", "structural")
def cross_benchmark(b: Bench) -> DataFrame:
    """Every benchmark's score from the embedding: Spearman and RMSE per benchmark, averaged."""
    s = b.benchmark_scores()
    scored = _per_benchmark(b, s, "score").join(s, ["model_id", "bench"])
    keys = ["draw", "bench"]
    rho = R.spearman(scored, keys, "score", "predicted")
    rmse = scored.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col("predicted"), F.lit(2.0)))).alias("rmse"))
    return _over_benchmarks(b, cut_lineage(rho.join(rmse, keys)), "spearman", ["spearman", "rmse"])


@task("error_type", "auroc", "structural")
def error_type(b: Bench) -> DataFrame:
    """Per-question AUROC of the decoded cells."""
    x = b.decoded().join(b.cells, ["model_id", "question_id"]).withColumn("p", F.round("predicted", 12))
    a = cut_lineage(R.auroc(x, ["question_id"], "acc", "p"))
    # the baseline knows how hard a question is and nothing of the model: one score for a whole column is a tie
    hard = b.cells.groupBy("question_id").agg(F.avg("acc").alias("m")).select("question_id", F.round("m", 12).alias("m"))
    easy = R.auroc(b.cells.join(hard, "question_id").withColumn("one", F.lit(1)), ["one"], "acc", "m").select("auroc")
    row = a.agg(F.avg("auroc").alias("auroc"), F.count("auroc").alias("n_questions"), easy.scalar().alias("difficulty_auroc"))
    per = a.where("auroc is not null").join(b.cells.select("question_id", "bench").distinct(), "question_id").select("bench", F.col("auroc").alias("y"))
    return with_interval(b, row, per, "mean", "auroc", ("bench",))


# ---------------------------------------------------------------- classes
def classify(b: Bench, labels: DataFrame, grouped: str | None = None) -> DataFrame:
    """(model_id, fold, label, predicted, score) for labels(model_id, label int)."""
    plan = fold_plan(b, grouped or "models", labels)
    rows = b.embedding.select("model_id", F.col("vec").alias("x")).join(labels, "model_id").join(plan.select("model_id", "fold"), "model_id")
    return cut_lineage(oof_logistic(rows))


def class_transfer(b: Bench, labels: DataFrame, min_members: int, grouped: str | None = None) -> DataFrame:
    """Macro-F1 over the classes with enough members, and its mean over permuted labels."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_members)
    use = cut_lineage(labels.join(counts, "label", "left_semi").select("model_id", "label"))
    n_classes = use.select("label").distinct().count()
    if n_classes < 2 or use.count() < MIN_FIT + MIN_SCORE:
        return absent(b, "macro_f1", f"{n_classes} usable classes on this cut")
    got = classify(b, use, grouped)
    classes = use.select(F.col("label").alias("cls")).distinct()
    shuffled = permutations(got.withColumn("t", F.col("label")), b.permutations, b.seed, ["predicted"], ["t"])
    null = R.macro_f1(shuffled, ["draw"], "t", "predicted", classes).agg(F.avg("macro_f1")).scalar()
    own = R.macro_f1(got.withColumn("one", F.lit(1)), ["one"], "label", "predicted", classes)
    row = own.select(
        "macro_f1", null.alias("permuted_null"), F.lit(n_classes).alias("n_classes"), F.lit(None).cast("string").alias("note")
    )
    known = sorted(r["cls"] for r in classes.collect())  # classes of MIN_FAMILY_MEMBERS models and more
    return with_interval(b, row, got.select("model_id", F.col("label").alias("y"), F.col("predicted").alias("p")), "macro_f1", "macro_f1", classes=known)


@task("family_classification", "macro_f1", "structural")
def family_classification(b: Bench) -> DataFrame:
    return class_transfer(b, b.models.select("model_id", F.col("family").cast("int").alias("label")), MIN_FAMILY_MEMBERS)


@task("base_vs_chat", "auroc", "structural")
def base_vs_chat(b: Bench) -> DataFrame:
    labels = b.models.select("model_id", F.col("is_chat").alias("label"))
    n = labels.select("label").distinct().count()
    if n < 2:
        return absent(b, "auroc", "one class only")
    got = classify(b, labels).withColumn("s", F.round("score", 9))
    row = R.auroc(got, [], "label", "s").select("auroc", "n_pos", "n_neg")
    return with_interval(b, row, got.select("model_id", F.col("label").alias("y"), F.col("s").alias("p")), "auroc", "auroc")


# ---------------------------------------------------------------- decisions
@task("stage5a_routing", "gap_closed", "decision")
def stage5a_routing(b: Bench) -> DataFrame:
    """Route each question to the model with the best decoded cell; price the rule between the best single model and the oracle."""
    from rosterlens.operators.selection import route

    pick = cut_lineage(route(b.decoded().withColumn("predicted", F.round("predicted", 12))))
    row = price_routing(b.cells, pick)
    # the gap over a redraw of benchmarks: gains of the rule and of the oracle over the best single model, question by question
    totals = b.cells.groupBy("model_id").agg(F.sum("acc").alias("s"))
    single = totals.agg(F.max_by("model_id", F.struct("s", -F.col("model_id"))).alias("m"))
    held = b.cells.join(single, F.col("model_id") == F.col("m")).select("question_id", F.col("acc").alias("single"))
    got = pick.select("model_id", "question_id").join(b.cells, ["model_id", "question_id"]).groupBy("question_id").agg(F.max("acc").alias("got"))
    per = b.cells.groupBy("question_id", "bench").agg(F.max("acc").alias("o")).join(held, "question_id", "left").join(got, "question_id", "left")
    base = F.coalesce("single", F.lit(0.0))
    per = per.select("bench", (F.col("o") - base).alias("y"), (F.coalesce("got", F.lit(0.0)) - base).alias("p"))
    return with_interval(b, row, per, "ratio", "gap_closed", ("bench",))


def price_routing(cells: DataFrame, pick: DataFrame) -> DataFrame:
    """gap_closed = (routed - best single) / (oracle - best single); an uncollected cell counts 0."""
    nq = cells.agg(F.countDistinct("question_id")).scalar()
    realised = pick.select("model_id", "question_id").join(cells, ["model_id", "question_id"]).agg(F.sum("acc").alias("r"))
    oracle = cells.groupBy("question_id").agg(F.max("acc").alias("o")).agg(F.sum("o")).scalar()
    single = cells.groupBy("model_id").agg(F.sum("acc").alias("s")).agg(F.max("s")).scalar()
    out = realised.select(
        (F.coalesce("r", F.lit(0.0)) / nq).alias("routing_acc"), (oracle / nq).alias("routing_oracle"),
        (single / nq).alias("routing_best_single"), nq.alias("n_routing_questions"),
    )
    head = F.col("routing_oracle") - F.col("routing_best_single")
    return out.select(
        "*", head.alias("oracle_headroom"),
        F.when(head > 1e-9, (F.col("routing_acc") - F.col("routing_best_single")) / head).alias("gap_closed"),
    )


@task("item_information", "spearman", "decision")
def item_information(b: Bench) -> DataFrame:
    """Do the decoded cells rank questions by discrimination and information as the true cells do?"""
    from rosterlens.operators.cells import item_statistics

    true = item_statistics(b.cells).select("question_id", F.round("discrimination", 12).alias("d"), F.round("fisher", 12).alias("f"))
    dec = item_statistics(b.decoded().withColumnRenamed("predicted", "acc")).select(
        "question_id", F.round("discrimination", 12).alias("dd"), F.round("fisher", 12).alias("df")
    )
    both = cut_lineage(true.join(dec, "question_id").dropna())
    disc = R.spearman(both, [], "d", "dd").select("spearman", "n")
    row = disc.withColumn("spearman_fisher", R.spearman(both, [], "f", "df").select("spearman").scalar())
    per = both.join(b.cells.select("question_id", "bench").distinct(), "question_id").select("bench", F.col("d").alias("y"), F.col("dd").alias("p"))
    return with_interval(b, row, per, "spearman", "spearman", ("bench",))


@task("external_topk", "auroc", "decision")
def external_topk(b: Bench) -> DataFrame:
    """Will a model land in a published board's top K?"""
    from rosterlens.operators.labels import shortlist

    if b.labels is None:
        return absent(b, "auroc", "no published board")
    short = cut_lineage(shortlist(b.published().withColumn("pos", F.col("board"))))
    n = short.count()
    if n == 0:
        return absent(b, "auroc", "no board lists 20 of the models")
    got = classify(b, short.select("model_id", "label")).withColumn("s", F.round("score", 9))
    k = short.agg(F.sum("label")).scalar()
    top = R.top_by(got.withColumn("one", F.lit(1)), ["one"], [F.col("s").desc(), F.col("model_id")], 10, "rn").filter(F.col("rn") <= k)
    precision = top.agg(F.avg("label")).scalar()
    perm = permutations(got, b.permutations, b.seed).select("draw", "model_id", "source_id")
    truth = got.select(F.col("model_id").alias("source_id"), F.col("label").alias("t"))
    shuffled = perm.join(truth, "source_id").join(got.select("model_id", "s"), "model_id")
    null = R.auroc(shuffled, ["draw"], "t", "s").agg(F.avg("auroc")).scalar()
    only = R.auroc(got.join(b.accuracy().select("model_id", F.round("y", 12).alias("a")), "model_id"), [], "label", "a").select("auroc").scalar()
    row = R.auroc(got, [], "label", "s").select(
        "auroc", precision.alias("precision_at_k"), (F.col("n_pos") / (F.col("n_pos") + F.col("n_neg"))).alias("precision_chance"),
        (F.col("n_pos") + F.col("n_neg")).alias("n_labelled"), null.alias("permuted_null"), only.alias("competence_only"),
    )
    return with_interval(b, row, got.select("model_id", F.col("label").alias("y"), F.col("s").alias("p")), "auroc", "auroc")


# ---------------------------------------------------------------- pairs, answers, traits
@task("pairwise", "auroc_mean", "structural")
def pairwise(b: Bench) -> DataFrame:
    """Which of two held-out models wins a benchmark: a ridge on their difference and its absolute value, over all pairs.

    Per benchmark the AUROC of a fold's pairs, averaged over benchmarks, then folds. The accuracy of a head on the difference
    alone comes with it; that one is fitted on ranks and its pairs are counted in rank order.
    """
    from rosterlens.operators import pair_heads as PH

    s = b.benchmark_scores().withColumn("score", F.round("score", 12))
    bank = replace(b, transfer_permutations=0)
    ranked = R.mid_rank(s, ["bench"], "score", "rank")
    scored = _per_benchmark(bank, ranked, "rank").drop("draw").join(s, ["model_id", "bench"]).join(b.fold_plan(), "model_id")
    won = R.concordance(cut_lineage(scored), ["bench", "fold"], "score", "predicted")
    linear = won.groupBy("bench").agg((F.sum(F.col("concordant") + F.col("tied") / 2) / F.sum("pairs")).alias("a")).agg(F.avg("a")).scalar()

    axis = cut_lineage(s.select("bench").distinct().withColumn("at", F.row_number().over(Window.orderBy("bench")) - 1))  # one row for each benchmark
    n = axis.count()
    held = s.join(axis, "bench").groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("at", "score"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at("m", i))
    rows = payload(rows_for(b, held.select("model_id", full.alias("y"))), "<f8")
    counts = PH.pair_scores(rows, (n,), [(PH.signed_differences, "bank")], PH.wins, n, True)
    per = cut_lineage(PH.counted_auroc(counts))
    folds = per.groupBy("fold").agg(F.avg("auroc").alias("auroc"), F.avg("accuracy").alias("accuracy"))
    row = folds.agg(F.avg("auroc").alias("auroc_mean"), F.avg("accuracy").alias("accuracy_mean"), F.count(F.lit(1)).alias("n_folds"))
    row = row.withColumn("accuracy_linear", linear).withColumn("n_pairs", per.agg(F.sum("n")).scalar())
    bench = per.where("auroc is not null").groupBy("target").agg(F.avg("auroc").alias("y"))
    return with_interval(b, row, bench, "mean", "auroc_mean", ("target",))


def payload(rows: DataFrame, dtype: str) -> DataFrame:
    """(model_id, fold, x, y): the embedding as ``x.bank``, and y as bytes of ``dtype`` with NaN where it is missing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(y=[np.array([np.nan if v is None else v for v in y], dtype).tobytes() for y in p["y"]])

    kind = dict(rows.dtypes)["model_id"]
    packed = rows.select("model_id", "fold", "x", "y").mapInPandas(run, f"model_id {kind}, fold int, x array<double>, y binary")
    return packed.select("model_id", "fold", F.struct(F.col("x").alias("bank")).alias("x"), "y")


def mean_divergence(answers: DataFrame) -> DataFrame:
    """(model_id, y, n): 1 - mean cosine to every other model's answer over the questions both answered.

    With unit vectors e and S_q their sum over the models of question q, the cosines of e to the
    others add up to e . S_q - 1, so no pair of models is listed.
    """
    from rosterlens.functions.vectors import dot, norm, unit
    from rosterlens.operators.banks import sum_vectors

    ones = answers.filter(norm("emb") > 0).withColumn("emb", unit("emb", 1e-12))
    total = staged(sum_vectors(ones, ["question_id"], "emb"))  # its size is known, so that the answers need not move to meet it
    j = ones.join(total, "question_id").filter("n > 1")
    return j.groupBy("model_id").agg(
        (1.0 - F.sum(dot("emb", "total") - 1.0) / F.sum(F.col("n") - 1)).alias("y"), F.sum(F.col("n") - 1).alias("n")
    )


#: Questions that two models must both have answered for their distance to count. A fixed value.
MIN_PAIR_COVERAGE = 8


@task("answer_divergence", "spearman_mean", "structural")
def answer_divergence(b: Bench) -> DataFrame:
    """How differently two models word their answers, pair by pair, from the embedding; the null knows the two accuracies only.

    A pair's distance is 1 less the mean cosine over all questions that both answered. The mean distance of a
    model to all others comes with it, predicted as a label of its own.
    """
    from rosterlens.operators import pair_heads as PH

    if "answers" not in b.cache:
        return absent(b, "spearman_mean", "no answer vectors on this run")
    answers = b.part("answers")
    asked = answers.select("question_id").distinct().withColumn("h", keyed_hash(b.seed, "divergence", F.col("question_id")))
    asked = staged(hash_position(asked, [], "h", "question_id").select("question_id", (F.col("pos") - 1).cast("int").alias("at")))
    dim = answers.select(F.size("emb").alias("n")).first()["n"]
    said = answers.join(asked, "question_id").select("model_id", "at", "emb")
    plan = b.fold_plan().select("model_id", F.col("fold").cast("int").alias("fold"))
    who = b.embedding.join(plan, "model_id").join(b.accuracy().select("model_id", F.col("y").alias("acc")), "model_id")
    who = cut_lineage(who.select("model_id", "fold", F.struct(F.col("vec").alias("bank"), F.array("acc").alias("level")).alias("x")))

    def lay_out(given: pa.Table, model: pa.Table) -> pa.Table:
        if not given.num_rows:
            return model.slice(0, 0).append_column("y", pa.array([], pa.binary()))
        vec = given.column("emb").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(given.num_rows, dim)
        held = PH.answer_bytes(given.column("at").to_numpy(), vec)
        return model.append_column("y", pa.array([held] * model.num_rows, pa.binary()))

    held = said.select(F.col("model_id").alias("given"), "at", "emb").groupBy("given")
    rows = held.cogroup(who.groupBy("model_id")).applyInArrow(lay_out, StructType([*who.schema, StructField("y", BinaryType())]))
    sizes = {r["fold"]: r["n"] for r in who.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    models = sum(sizes.values())
    block = PH.block_rows(models, answers.count() / max(1, models) * (4 + 4 * dim))
    counts = PH.pair_scores(rows, (), [(PH.symmetric, "bank"), (PH.level_and_gap, "level")], PH.AnswerDistance(MIN_PAIR_COVERAGE, dim), 1, False, block=block, sizes=sizes)
    per = cut_lineage(PH.counted_spearman(counts).where(F.col("n") >= MIN_SCORE))
    if per.where("kind = 0").isEmpty():
        return absent(b, "spearman_mean", "no fold has enough measured pairs")
    of = lambda k, e: F.avg(F.when(F.col("kind") == k, e))
    row = per.agg(
        of(0, F.col("spearman")).alias("spearman_mean"), of(1, F.col("spearman")).alias("spearman_competence_null"),
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("n_scored_pairs"), F.count_if(F.col("kind") == 0).alias("n_folds_scored"),
    )
    one = scalar_transfer(b, mean_divergence(answers).select("model_id", "y"), "spearman")
    row = row.withColumn("spearman_of_means", one.select("spearman").scalar())
    folds = per.where("kind = 0 and spearman is not null").select("fold", F.col("spearman").alias("y"))
    return with_interval(b, row, folds, "mean", "spearman_mean", ("fold",))


@task("model_authorship", "top1", "traits")
def model_authorship(b: Bench) -> DataFrame:
    """Match a predicted benchmark profile to the model it belongs to, top-1 against 1/n.

    The closest true profile is a nearest-neighbour search in blocks.
    """
    from rosterlens.operators.embed import zscore
    from rosterlens.operators.neighbours import nearest_between

    s = b.benchmark_scores()
    y, _ = wide_target(s, "bench", "score")
    z = cut_lineage(zscore(y, "y", F.lit(True), "z").select("model_id", F.col("z").alias("y")))
    out = oof_ridge(rows_for(b, z))
    near = nearest_between(out.select("model_id", F.col("predicted").alias("emb")), z.select("model_id", F.col("y").alias("emb")), 1)
    hits = cut_lineage(near.select("model_id", (F.col("model_id") == F.col("other")).cast("double").alias("y")))
    row = hits.agg(F.avg("y").alias("top1"), (F.lit(1.0) / F.count(F.lit(1))).alias("chance"), F.count(F.lit(1)).alias("n_models"))
    return with_interval(b, row, hits, "mean", "top1")


def rm_style(b: Bench) -> DataFrame:
    """Mean reward once the correctness effect is removed; each model's residual comes from a fit without its fold."""
    from rosterlens.operators.labels import residual_out_of_fold

    if "measures" not in b.cache:
        return absent(b, "spearman", "no reward labels on this run")
    res = residual_out_of_fold(b.part("measures"), b.fold_plan())
    return scalar_transfer(b, res.groupBy("model_id").agg(F.avg("residual").alias("y")), "spearman", competence=True)


def rm_mean(b: Bench) -> DataFrame:
    """Mean reward of a model's scored cells."""
    if "measures" not in b.cache:
        return absent(b, "spearman", "no reward labels on this run")
    return scalar_transfer(b, b.part("measures").groupBy("model_id").agg(F.avg("rm").alias("y")), "spearman", competence=True)


for _fn in (rm_style, rm_mean):
    TASKS[_fn.__name__] = TaskSpec(_fn.__name__, "spearman", _fn, "reward", source="measures", label="rm")


#: Components of a profile, the first of which is competence; half-splits scored, and those behind the reliability. Fixed values.
PROFILE, PROFILE_DRAWS, RELIABILITY_DRAWS = 8, 5, 20


def half_profiles(b: Bench, draws: int, reliability: int) -> DataFrame:
    """(key, model_id, vec): later components of question halves, all decomposed together.

    Keys: the second half of each of ``draws`` half-splits; then both halves of each of ``reliability`` further ones; then those
    again without the model of the fewest cells.
    """
    from rosterlens.operators.fusion import keyed_components
    from rosterlens.operators.splits import half_splits

    half = half_splits(b.cells.select("question_id").distinct(), draws + reliability, b.seed)
    side = half.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "half"))), lambda x: x["half"]).alias("h"))
    counts = b.cells.groupBy("model_id").agg(F.count(F.lit(1)).alias("k"))
    thin = counts.agg(F.min_by("model_id", F.struct("k", "model_id"))).scalar()
    rows = b.cells.withColumn("thin", F.col("model_id") == thin)
    means = rows.groupBy("question_id").agg(F.avg("acc").alias("m"), F.avg(F.when(~F.col("thin"), F.col("acc"))).alias("m_ex")).join(side, "question_id")
    inside = lambda d, h, x: F.when(F.col("h")[d] == h, x).otherwise(0.0)
    own, ex = F.col("acc") - F.col("m"), F.when(F.col("thin"), 0.0).otherwise(F.coalesce(F.col("acc") - F.col("m_ex"), F.lit(0.0)))
    retest = [(d, h) for d in range(draws, draws + reliability) for h in (1, 2)]
    v = [inside(d, 2, own) for d in range(draws)] + [inside(d, h, own) for d, h in retest] + [inside(d, h, ex) for d, h in retest]
    cells = cut_lineage(rows.join(means, "question_id").select("model_id", "question_id", F.array(*v).alias("v")))
    scores = keyed_components(cells, len(v), PROFILE)
    return cut_lineage(scores.select("key", "model_id", F.slice("vec", 2, PROFILE - 1).alias("vec")))


def _agreement(pairs: DataFrame) -> DataFrame:
    """(draw, r): correlation over all cells of two profiles pairs(draw, model_id, a, b); components are known up to sign and aligned first."""
    long = pairs.select("draw", F.posexplode(F.arrays_zip("a", "b")).alias("dim", "c")).select("draw", "dim", F.col("c.a").alias("a"), F.col("c.b").alias("b"))
    sign = long.groupBy("draw", "dim").agg(F.signum(F.sum(F.col("a") * F.col("b")) + 1e-12).alias("sg"))
    return long.join(sign, ["draw", "dim"]).withColumn("b", F.col("b") * F.col("sg")).groupBy("draw").agg(R.pearson("a", "b").alias("r"))


@task("specialisation", "r2_profile_pc2plus", "downstream")
def specialisation(b: Bench) -> DataFrame:
    """What a model is good at, competence removed: the later components of a question half, over five half-splits.

    The reliability says how far two halves agree on the target (twenty half-splits, also without the model of the fewest
    cells); the null is the same fit on forty permuted banks; the competence R2 is that of the half's mean.
    """
    from rosterlens.operators.splits import half_splits

    draws, retest, dims = PROFILE_DRAWS, RELIABILITY_DRAWS, PROFILE - 1
    if b.cells.select("question_id").distinct().count() < 8 or b.embedding.count() < MIN_FIT + MIN_SCORE:
        return absent(b, "r2_profile_pc2plus", "too few questions or models to split")
    profiles = half_profiles(b, draws, retest)
    targets = profiles.where(F.col("key") < draws).select("model_id", "key", F.posexplode("vec").alias("dim", "y"))
    half = half_splits(b.cells.select("question_id").distinct(), draws + retest, b.seed).where((F.col("half") == 2) & (F.col("draw") < draws))
    level = b.cells.join(half, "question_id").groupBy("model_id", F.col("draw").alias("key")).agg(F.avg("acc").alias("y")).withColumn("dim", F.lit(dims))
    targets = cut_lineage(targets.unionByName(level.select("model_id", "key", "dim", "y")))
    named = targets.withColumn("bench", F.concat_ws(":", "key", "dim"))
    got = _per_benchmark(b, named, "y").join(named, ["model_id", "bench"]).select("draw", "key", "dim", "model_id", "y", F.col("predicted").alias("p"))
    got = cut_lineage(got)
    r2 = R.r2_pooled(got.where(F.col("dim") < dims), ["draw", "key"], ["dim"], "y", "p")
    r2 = cut_lineage(r2.select("draw", "key", "r2"))
    level_r2 = R.r2_pooled(got.where((F.col("dim") == dims) & (F.col("draw") == 0)), ["key"], [], "y", "p").agg(F.avg("r2")).scalar()
    null = r2.where("draw > 0").groupBy("draw").agg(F.avg("r2").alias("r2")).agg(F.avg("r2")).scalar()

    def agreement(first: int) -> DataFrame:
        part = profiles.where((F.col("key") >= first) & (F.col("key") < first + 2 * retest)).withColumn("at", F.col("key") - first)
        halves = [part.where(F.col("at") % 2 == h).select(F.floor(F.col("at") / 2).alias("draw"), "model_id", F.col("vec").alias(n)) for h, n in ((0, "a"), (1, "b"))]
        return _agreement(halves[0].join(halves[1], ["draw", "model_id"]))

    rel = cut_lineage(agreement(draws))
    spread = rel.agg(F.avg("r").alias("m"), F.percentile("r", 0.025).alias("lo"), F.percentile("r", 0.975).alias("hi")).first()
    without = agreement(draws + 2 * retest).agg(F.avg("r")).first()[0]
    row = r2.where("draw = 0").agg(
        F.avg("r2").alias("r2_profile_pc2plus"), F.min("r2").alias("draw_lo"), F.max("r2").alias("draw_hi"),
        null.alias("permuted_null"), level_r2.alias("r2_competence"), F.lit(draws).alias("n_splits"),
        *[F.lit(v).cast("double").alias(n) for n, v in (("target_reliability", spread["m"]), ("target_reliability_lo", spread["lo"]), ("target_reliability_hi", spread["hi"]), ("target_reliability_ex_thinnest", without))],
    )
    # R2 of each split over redrawn models: squared errors, and sums and squares of each column
    own = got.where((F.col("draw") == 0) & (F.col("dim") < dims))
    at = F.col("key") * dims + F.col("dim")
    wide = own.groupBy("model_id").agg(
        *[F.sum(F.when(F.col("key") == k, F.pow(F.col("y") - F.col("p"), F.lit(2.0))).otherwise(0.0)).alias(f"e{k}") for k in range(draws)],
        *[F.sum(F.when(at == i, F.col("y")).otherwise(0.0)).alias(f"y{i}") for i in range(draws * dims)],
    )

    def stat(rows: DataFrame) -> DataFrame:
        ys = [F.col(f"y{i}") for i in range(draws * dims)]
        v = intervals.weighted_sums(rows, [F.lit(1), *[F.col(f"e{k}") for k in range(draws)], *ys, *[y * y for y in ys]])
        first = 1 + draws
        parts = []
        for k in range(draws):
            columns = range(k * dims, (k + 1) * dims)
            total = F.aggregate(F.array(*[F.col("v")[first + draws * dims + i] - F.col("v")[first + i] * F.col("v")[first + i] / F.col("v")[0] for i in columns]), F.lit(0.0), lambda x, y: x + y)
            parts.append(F.when(total > R.EPS, 1 - F.col("v")[1 + k] / total))
        held = F.filter(F.array(*parts), lambda x: x.isNotNull())
        return v.select("draw", F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda x, y: x + y) / F.size(held)).alias("stat"))

    return with_interval(b, row, wide, stat, "r2_profile_pc2plus")


def permuted_decodes(b: Bench, draws: int) -> tuple[DataFrame, DataFrame]:
    """((draw, model_id, predicted array), axis(pos, question_id)): cells decoded from the bank (draw 0) and from ``draws`` permuted banks."""
    cells = b.cells.select("model_id", F.col("question_id").alias("bench"), "acc")
    out, axis = _per_model(replace(b, transfer_permutations=draws), cells, "acc", per_target=False)
    return out, axis.select("pos", F.col("bench").alias("question_id"))


@task("knapsack", "headroom_at_24gb", "downstream")
def knapsack(b: Bench) -> DataFrame:
    """A portfolio chosen on decoded cells against one chosen on true cells, under four memory budgets.

    Chosen on one question half, scored on the other, over ten half-splits. Chance is the mean of twenty random affordable
    squads of the reference's size; the null is the same walk on forty permuted banks, at the first budget. Headroom is what a
    portfolio adds over chance as a share of what the reference adds. All walks run side by side.
    """
    from rosterlens.operators import portfolio as PF
    from rosterlens.operators.splits import half_splits

    spark = b.embedding.sparkSession
    draws, squads, permuted = (b.cache.get("knapsack", {}).get(k, d) for k, d in (("draws", PF.DRAWS), ("squads", PF.SQUADS), ("permuted", PF.PERMUTED)))
    cost = cut_lineage(b.models.filter(F.col("vram_gb").isNotNull()).select("model_id", F.col("vram_gb").alias("gb")))
    if cost.filter(F.col("gb") <= max(PF.BUDGETS)).isEmpty():
        return absent(b, "headroom_at_24gb", "nothing fits the budget")
    half = cut_lineage(half_splits(b.cells.select("question_id").distinct(), draws, b.seed))
    fit, held = half.filter("half = 1").drop("half"), half.filter("half = 2").drop("half")
    n_held = held.groupBy("draw").agg(F.count(F.lit(1)).alias("n_held"))
    true = b.cells.join(cost, "model_id", "left_semi").select("model_id", "question_id", F.col("acc").alias("a"))
    guess, axis = permuted_decodes(b, permuted)
    axis = cut_lineage(axis.select("question_id", F.col("pos").cast("int").alias("pos")))
    guess = guess.join(cost, "model_id", "left_semi").select(
        F.col("draw").alias("bank"), "model_id", F.sequence(F.lit(1), F.size("predicted")).alias("pos"), F.transform("predicted", lambda x: F.greatest(x, F.lit(0.0))).alias("a")
    )
    # a walk reads the draw's half of one bank: the true cells (-1), the decoded ones (0) or a permuted copy of them
    banks = PF.packed(true.withColumn("bank", F.lit(-1)), axis).unionByName(guess)
    spec = [(d, c, g) for d in range(draws) for c in range(-1, permuted + 1) for g in (PF.BUDGETS if c <= 0 else (PF.HEADLINE,))]
    walks = cut_lineage(spark.createDataFrame([(i, *s) for i, s in enumerate(spec)], "walk int, draw int, copy int, budget double"))
    paths = walks.select("walk", F.col("copy").alias("bank"), "budget", F.col("draw").alias("part"))
    picks = cut_lineage(PF.greedy_packed(banks, axis, cost, paths, fit.withColumnRenamed("draw", "part")))
    scored = cut_lineage(true.join(held, "question_id").select(F.col("draw").alias("bank"), "model_id", "question_id", "a"))
    own = walks.select("walk", F.col("draw").alias("bank"))
    kinds = walks.select("walk", "draw", "copy", "budget")
    value = PF.squad_rows(scored, picks.join(own, "walk")).join(kinds, "walk")
    size = picks.groupBy("walk").agg(F.count(F.lit(1)).alias("size")).join(kinds.where("copy = -1"), "walk").select("walk", "draw", "budget", "size")
    drawn = PF.random_squads_of(cost, size, squads, b.seed)
    spread = drawn.join(own, "walk").join(scored, ["bank", "model_id"]).groupBy("walk", "squad", "question_id").agg(F.max("a").alias("best"))
    chance = spread.groupBy("walk", "question_id").agg((F.sum("best") / squads).alias("best")).join(kinds, "walk").withColumn("copy", F.lit(-2))
    bench = b.cells.select("question_id", "bench").distinct()
    # sums by benchmark: what the means and the interval over benchmarks read
    sums = value.select("draw", "copy", "budget", "question_id", "best").unionByName(chance.select("draw", "copy", "budget", "question_id", "best"))
    sums = cut_lineage(sums.join(bench, "question_id").groupBy("draw", "copy", "budget", "bench").agg(F.sum("best").alias("s")))
    per = sums.groupBy("draw", "copy", "budget").agg(F.sum("s").alias("s")).join(n_held, "draw").withColumn("v", F.col("s") / F.col("n_held"))
    part = lambda c, name: per.where(F.col("copy") == c).select("draw", "budget", F.col("v").alias(name))
    base = part(-1, "reference").where("reference > 0").join(part(-2, "chance"), ["draw", "budget"], "left").fillna(0.0, ["chance"])
    base = cut_lineage(base.join(part(0, "predicted"), ["draw", "budget"], "left").fillna(0.0, ["predicted"]))
    head = lambda v: F.when(F.col("reference") - F.col("chance") > 1e-9, (F.col(v) - F.col("chance")) / (F.col("reference") - F.col("chance")))
    at = lambda g, e: F.avg(F.when(F.col("budget") == g, e))
    row = base.agg(
        *[at(g, head("predicted")).alias(f"headroom_at_{g:.0f}gb") for g in PF.BUDGETS],
        *[at(g, F.col("predicted") / F.col("reference")).alias(f"retention_at_{g:.0f}gb") for g in PF.BUDGETS],
        *[at(g, F.col("chance") / F.col("reference")).alias(f"random_retention_at_{g:.0f}gb") for g in PF.BUDGETS],
        F.lit(draws).alias("n_draws"), F.lit(squads).alias("n_null_squads"),
    )
    null = per.where("copy > 0").select("draw", "budget", F.col("v").alias("shuffled")).join(base, ["draw", "budget"])
    row = row.withColumn("permuted_null", null.agg(F.avg(head("shuffled"))).scalar()).withColumn("n_models_weighted", F.lit(cost.count()))
    # the mean over draws of (predicted - chance) / (reference - chance), benchmarks redrawn
    names = [(d, c) for d in range(draws) for c in (0, -2, -1)]
    wide = sums.where(F.col("budget") == PF.HEADLINE).groupBy("bench").agg(
        *[F.sum(F.when((F.col("draw") == d) & (F.col("copy") == c), F.col("s")).otherwise(0.0)).alias(f"s{i}") for i, (d, c) in enumerate(names)]
    )
    row = cut_lineage(row)
    return _interval_of_ratios(b, row, "headroom_at_24gb", wide, "bench", draws)


def _interval_of_ratios(b: Bench, row: DataFrame, point: str, wide: DataFrame, unit: str, draws: int) -> DataFrame:
    """``row`` with the interval of the mean over draws of (s0 - s1) / (s2 - s1), columns of wide(unit, s0, s1, ...) summed over redrawn units."""

    def stat(rows: DataFrame) -> DataFrame:
        v = intervals.weighted_sums(rows, [F.col(f"s{i}") for i in range(3 * draws)])
        ratios = [
            F.when(F.col("v")[3 * d + 2] - F.col("v")[3 * d + 1] > 1e-9, (F.col("v")[3 * d] - F.col("v")[3 * d + 1]) / (F.col("v")[3 * d + 2] - F.col("v")[3 * d + 1]))
            for d in range(draws)
        ]
        held = F.filter(F.array(*ratios), lambda x: x.isNotNull())
        return v.select("draw", F.when(F.size(held) > 0, F.aggregate(held, F.lit(0.0), lambda x, y: x + y) / F.size(held)).alias("stat"))

    return with_interval(b, row, wide, stat, point, (unit,))


# ---------------------------------------------------------------- cards
def register_card_class(name: str, grouped: str | None, min_members: int = 3) -> None:
    def run(b: Bench) -> DataFrame:
        if "cards" not in b.cache:
            return absent(b, "macro_f1", "no model cards on this run")
        labels = b.part("cards").filter(F.col(name).isNotNull() & (F.col(name) != "unknown"))
        classes = labels.select(name).distinct().select(name, F.xxhash64(name).alias("h"))
        codes = hash_position(classes, [], "h", name)
        coded = labels.join(codes, name).select("model_id", F.col("pos").cast("int").alias("label"))
        return class_transfer(b, coded, min_members, grouped)

    TASKS[name] = TaskSpec(name, "macro_f1", run, "cards", source="cards", label=name, folds=grouped or "models")


def register_card_value(name: str, grouped: str | None) -> None:
    def run(b: Bench) -> DataFrame:
        if "cards" not in b.cache:
            return absent(b, "spearman", "no model cards on this run")
        return scalar_transfer(b, b.part("cards").select("model_id", F.col(name).alias("y")), "spearman", grouped)

    TASKS[name] = TaskSpec(name, "spearman", run, "cards", source="cards", label=name, folds=grouped or "models")


# Fixed names; properties of a base model are folded by family.
register_card_value("hf_downloads", None)
register_card_value("hf_context_length", "family")
register_card_value("hf_release_date", None)
register_card_class("hf_architecture_family", "family")
register_card_class("hf_license_type", None)


# ---------------------------------------------------------------- label columns
def register_label_task(board: str, primary: str = "spearman", group: str = "external") -> None:
    """One task per label column: the same query, another board."""

    def run(b: Bench) -> DataFrame:
        if b.labels is None:
            return absent(b, primary, "no labels on this run")
        y = b.published().filter(F.col("board") == board).select("model_id", F.col("value").alias("y"))
        return scalar_transfer(b, y, primary, competence=True)

    TASKS[board] = TaskSpec(board, primary, run, group, source="boards", label=board)


def register_trait_task(name: str, trait: str) -> None:
    """A task whose label is one measured trait of a model's answers."""

    def run(b: Bench) -> DataFrame:
        if "traits" not in b.cache or trait not in b.part("traits").columns:
            return absent(b, "spearman", f"no {trait} on this run")
        return scalar_transfer(b, b.part("traits").select("model_id", F.col(trait).alias("y")), "spearman", competence=True)

    TASKS[name] = TaskSpec(name, "spearman", run, "traits", source="traits", label=trait)


# Fixed names of the trait-driven tasks and the traits they read.
TRAIT_TASKS = {"length_profile": "log_n_tok", "hedge_style": "hedge_rate", "refusal_rate": "refusal_rate"}
for _name, _trait in TRAIT_TASKS.items():
    register_trait_task(_name, _trait)


# Fixed names of the label-driven tasks.
BOARD_TASKS = (
    "chatbot_arena_elo",
    "alpacaeval_winrate",
    "open_llm_leaderboard",
    "open_llm_leaderboard_v2",
    "i_math_score",
    "i_gpqa_score",
    "instruction_following",
    "ext_arena_rating",
    "ext_arena_rating_coding",
    "ext_arena_style_delta",
    "ext_arena_style_delta_creative",
    "ext_arena_style_delta_math",
    "ext_ayumi_rp_rank",
    "ext_ayumi_rp_iq",
    "ext_canaicode_junior",
    "ext_canaicode_senior",
    "ext_livebench_language",
    "ext_moral_machine_human_distance",
    "ext_llmmap_refusal",
    "serving_providers_live",
    "ollama_quant_menu",
    "ugi_willingness",
    "lb_pt_average",
)
for _name in BOARD_TASKS:
    register_label_task(_name)


def task_table(b: Bench) -> DataFrame:
    """(task, grp, source, label, folds, floor, n_labelled, runnable, reason) of every registered task.

    Tasks are rows, joined once with how many models each label column covers; nothing is fitted. A task whose source
    is not on the run, or whose label too few models have, is not runnable and says why.
    """
    spark = b.embedding.sparkSession
    specs = spark.createDataFrame(
        [(t.name, t.group, t.source, t.label, t.folds, t.floor) for t in TASKS.values()], "task string, grp string, source string, label string, folds string, floor int"
    )
    models = b.embedding.select("model_id")
    counts = None

    def add(df: DataFrame) -> None:
        nonlocal counts
        counts = df if counts is None else counts.unionByName(df)

    def wide(name: str) -> None:
        table = b.part(name).join(models, "model_id", "left_semi")
        columns = sorted({t.label for t in TASKS.values() if t.source == name} & set(table.columns))
        one = table.agg(*[F.count(c).alias(c) for c in columns])
        add(one.select(F.lit(name).alias("source"), F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("n")) for c in columns])).alias("e")).select("source", "e.label", "e.n"))

    if b.labels is not None:
        held = b.published().where("board is not null and value is not null").join(models, "model_id", "left_semi")
        add(held.groupBy(F.col("board").alias("label")).agg(F.countDistinct("model_id").alias("n")).select(F.lit("boards").alias("source"), "label", "n"))
    if "measures" in b.cache:
        held = b.part("measures").where("rm is not null").join(models, "model_id", "left_semi")
        add(held.agg(F.countDistinct("model_id").alias("n")).select(F.lit("measures").alias("source"), F.lit("rm").alias("label"), "n"))
    for name in ("traits", "cards"):
        if name in b.cache:
            wide(name)
    every = models.agg(F.countDistinct("model_id").alias("n")).select(F.lit("").alias("source"), F.lit("").alias("label"), "n")
    add(every)
    there = [name for name, ok in (("boards", b.labels is not None), *((n, n in b.cache) for n in ("traits", "measures", "cards"))) if ok]
    joined = specs.join(counts, ["source", "label"], "left").withColumn("n_labelled", F.coalesce("n", F.lit(0)).cast("bigint"))
    known = F.col("source").isin("", *there)
    few = F.concat_ws(" ", F.col("n_labelled").cast("string"), F.lit("labelled models,"), F.col("floor").cast("string"), F.lit("needed"))
    reason = F.when(~known, F.concat(F.lit("no "), F.col("source"), F.lit(" on this run"))).when(F.col("n_labelled") < F.col("floor"), few)
    return joined.select("task", "grp", "source", "label", "folds", "floor", "n_labelled", reason.isNull().alias("runnable"), reason.alias("reason"))


def runnable(b: Bench, names: list[str] | None = None) -> tuple[list[str], dict[str, str]]:
    """(tasks that can run, in registered order; the others with the reason)."""
    rows = {r["task"]: r for r in task_table(b).collect()}
    wanted = [n for n in TASKS if names is None or n in names]
    return [n for n in wanted if rows[n]["runnable"]], {n: rows[n]["reason"] for n in wanted if not rows[n]["runnable"]}


def run_tasks(b: Bench, names: list[str]) -> DataFrame:
    """results(task, metric, value, note, error): one long table; a failing task becomes an error row."""
    unknown = sorted(set(names) - set(TASKS))
    if unknown:
        raise ValueError(f"unknown tasks: {unknown}")
    out = None
    for name in names:
        spec = TASKS[name]
        try:
            df = spec.run(b)
            if spec.primary not in df.columns:
                raise ValueError(f"the result lacks its primary metric {spec.primary}")
            note = F.col("note") if "note" in df.columns else F.lit(None).cast("string")
            metrics = [c for c in df.columns if c != "note"]
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics]))
            rows = df.select(pairs.alias("p"), note.alias("note")).select(
                F.lit(name).alias("task"), "p.metric", "p.value", "note", F.lit(None).cast("string").alias("error")
            )
            rows = cut_lineage(rows)
        except Exception as exc:  # noqa: BLE001 - a task's failure is a result
            rows = b.embedding.agg(F.lit(str(exc)).alias("error")).select(
                F.lit(name).alias("task"), F.lit(spec.primary).alias("metric"), F.lit(None).cast("double").alias("value"),
                F.lit(None).cast("string").alias("note"), "error",
            )
        out = rows if out is None else out.unionByName(rows)
    return out


