"""Runs of a protocol: every arm at every fold and seed, refits without a benchmark, and the manifest that describes them.

An arm is fitted for all folds of a plan in one go. A finished protocol is four tables in one folder:

run_arms     one row for each run and arm: fitted or skipped and why, seeds, widths, what it was fitted on
run_split    which side of a run each model stands on
run_blocks   the questions of each block, for each refit
run_vectors  the fitted vectors of every run
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlens.operators import embed, irt
from rosterlens.operators import fusion as FU
from rosterlens.operators.heads import ALPHAS, SD_FLOOR
from rosterlens.operators.splits import derangement, gaussian_floor, without_benchmarks
from rosterlens.session import staged

#: The refit that leaves nothing out.
WHOLE = ""
TABLES = ("run_arms", "run_split", "run_blocks", "run_vectors")


@dataclass
class Inputs:
    """What arms are fitted on: cells of the fitting blocks, a fold plan and the text channels that are there."""

    cells: DataFrame  # (model_id, question_id, correct)
    plan: DataFrame  # (model_id, fold)
    qtext: DataFrame | None = None  # (question_id, emb)
    anstext: DataFrame | None = None  # (model_id, emb)
    answers: DataFrame | None = None  # (model_id, question_id, emb)
    width: int = 32
    cache: dict = field(default_factory=dict)

    def packed(self) -> FU.Packed:
        """The cells packed for products, made once for all arms, seeds and texts."""
        if "packed" not in self.cache:
            self.cache["packed"] = FU.pack(self.cells, self.plan)
        return self.cache["packed"]

    def gathered(self) -> FU.Gathered:
        """Sums that all arms share, made once."""
        if "sums" not in self.cache:
            self.cache["sums"] = FU.gather(self.packed(), self.plan, self.qtext, self.anstext)
        return self.cache["sums"]

    def folds(self) -> int:
        if "folds" not in self.cache:
            self.cache["folds"] = self.plan.agg(F.max("fold")).first()[0] + 1
        return self.cache["folds"]

    def every_run(self, vectors: DataFrame) -> DataFrame:
        """(run, model_id, side, vec): vectors that don't depend on the fold, in every run."""
        side = F.when(F.col("run") == F.col("fold"), "test").otherwise("train")
        rows = self.plan.where(F.col("fold") != FU.NEVER).select("model_id", "fold").join(vectors, "model_id")
        rows = rows.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(self.folds() - 1))))
        return rows.select("run", "model_id", side.alias("side"), "vec")


@dataclass(frozen=True)
class Arm:
    """fit(inputs, seed) -> (run, model_id, side, vec): models outside a run's fold are fitted, the fold's are placed.

    ``needs`` are the inputs it reads; an arm whose inputs are not there is skipped. One that is not ``seeded`` is fitted
    once and stands for all seeds. A refit calls the same function on the inputs left.
    """

    name: str
    needs: tuple[str, ...]
    fit: Callable[[Inputs, int], DataFrame]
    seeded: bool = False


ARMS: dict[str, Arm] = {}


def arm(name: str, needs: Sequence[str] = (), seeded: bool = False) -> Callable[[Callable[[Inputs, int], DataFrame]], Callable]:
    """Register an arm."""

    def add(fn: Callable[[Inputs, int], DataFrame]) -> Callable:
        ARMS[name] = Arm(name, tuple(needs), fn, seeded)
        return fn

    return add


def _fusion(channels: tuple[str, ...]) -> None:
    arm("pls_" + "_".join(channels), [c for c in channels if c != "bits"])(lambda inputs, seed: FU.pls(inputs.gathered(), channels, inputs.width))


for _channels in (("bits", "qtext"), ("bits", "anstext"), ("qtext", "anstext"), FU.CHANNELS):
    _fusion(_channels)


@arm("pca_bits", seeded=True)
def pca_bits(inputs: Inputs, seed: int) -> DataFrame:
    return FU.bits_components(inputs.gathered(), inputs.width, seed)


@arm("pca_channels", ["qtext", "anstext"], seeded=True)
def pca_channels(inputs: Inputs, seed: int) -> DataFrame:
    return FU.channel_components(inputs.gathered(), FU.CHANNELS, inputs.width, seed)


@arm("ability_2pl")
def ability_2pl(inputs: Inputs, seed: int) -> DataFrame:
    """One ability for each model: items fitted on a run's training side, its own models placed on them. A model without cells stands at 0."""
    out = None
    members = inputs.plan.where(F.col("fold") != FU.NEVER)
    for run in range(inputs.folds()):
        train = inputs.cells.join(members.where(F.col("fold") != run), "model_id", "left_semi")
        fit = irt.fit_2pl(train, seed)
        placed = irt.fold_in_ability(inputs.cells.join(members.where(F.col("fold") == run), "model_id", "left_semi"), fit.items)
        rows = members.join(fit.theta.unionByName(placed), "model_id", "left").withColumn("run", F.lit(run))
        out = rows if out is None else out.unionByName(rows)
    side = F.when(F.col("run") == F.col("fold"), "test").otherwise("train")
    return out.select("run", "model_id", side.alias("side"), F.array(F.coalesce("theta", F.lit(0.0))).alias("vec"))


@arm("random_fingerprint", ["answers"], seeded=True)
def random_fingerprint(inputs: Inputs, seed: int) -> DataFrame:
    """All answers to the fitting questions under one random projection."""
    asked = inputs.answers.join(inputs.cells.select("question_id").distinct(), "question_id", "left_semi")
    dim = asked.select(F.size("emb").alias("n")).first()["n"]
    return inputs.every_run(embed.random_fingerprint(asked, asked.select("question_id").distinct(), inputs.width, dim, seed))


@arm("text_only", ["anstext"])
def text_only(inputs: Inputs, seed: int) -> DataFrame:
    """The answer text as it is; a model without any has no row."""
    return inputs.every_run(inputs.anstext.where("emb is not null").select("model_id", F.transform("emb", lambda x: x.cast("double")).alias("vec")))


@arm("pls_shuffled_anstext", ["anstext"], seeded=True)
def pls_shuffled_anstext(inputs: Inputs, seed: int) -> DataFrame:
    """The fusion of bits with another model's answer text: within a fold no model reads its own, so no text crosses a split."""
    own = inputs.anstext.join(inputs.plan, "model_id").where("emb is not null")
    swap = derangement(own, "fold", "model_id", seed).select("model_id", F.coalesce("other", "model_id").alias("other"))
    text = swap.join(own.select(F.col("model_id").alias("other"), "emb"), "other").select("model_id", "emb")
    return FU.pls(FU.gather(inputs.packed(), inputs.plan, None, text), ("bits", "anstext"), inputs.width)


@arm("pls_shuffled_qtext", ["qtext"], seeded=True)
def pls_shuffled_qtext(inputs: Inputs, seed: int) -> DataFrame:
    """The fusion of bits with another question's text in the place of each question's own."""
    rows = inputs.qtext.withColumn("side", F.lit(0))
    swap = derangement(rows, "side", "question_id", seed).select("question_id", F.coalesce("other", "question_id").alias("other"))
    text = swap.join(rows.select(F.col("question_id").alias("other"), "emb"), "other").select("question_id", "emb")
    return FU.pls(FU.gather(inputs.packed(), inputs.plan, text, None), ("bits", "qtext"), inputs.width)


@arm("null_random", seeded=True)
def null_random(inputs: Inputs, seed: int) -> DataFrame:
    """Standard normal vectors: the floor of the width."""
    table = gaussian_floor(inputs.plan.select("model_id"), inputs.width, 1, seed).groupBy("model_id")
    vec = F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"])
    return inputs.every_run(table.agg(vec.alias("vec")))


@dataclass
class Protocol:
    """What a protocol asks for: blocks(question_id, bench, block), the arms, seeds and the benchmarks left out in refits."""

    blocks: DataFrame
    arms: Sequence[str]
    seeds: Sequence[int] = (0,)
    refits: Sequence[str] = ()


def _missing(inputs: Inputs, a: Arm) -> str | None:
    lost = [c for c in a.needs if getattr(inputs, c) is None]
    return f"no input: {', '.join(lost)}" if lost else None


def _part(values: dict) -> list:
    return [F.lit(v).alias(k) for k, v in values.items()]


def fit_runs(inputs: Inputs, protocol: Protocol, root: str) -> None:
    """Fit every arm at every fold and seed, and again without each benchmark of ``refits``, and write the four tables to ``root``.

    Sums over cells are kept by fold and question: a run's fit is the total less its fold, so folds add no pass. An arm that
    lacks an input, or fails, does not stop the others: its row says why. Unknown arms, an empty eval block, a refit
    that leaves nothing to fit on, and cells of eval questions among the fitted ones are errors.
    """
    unknown = [a for a in protocol.arms if a not in ARMS]
    if unknown:
        raise ValueError(f"unknown arms {unknown}; there are {sorted(ARMS)}")
    spark = inputs.cells.sparkSession
    sizes = {}
    # the vectors' table is there even if every arm is skipped
    empty = inputs.plan.limit(0).select(*_part({"refit": "", "arm": ""}), F.lit(0).alias("seed"), F.col("fold").cast("int").alias("run"), "model_id", F.lit("").alias("side"), F.array().cast("array<double>").alias("vec"))
    empty.write.parquet(f"{root}/run_vectors")
    for refit in (WHOLE, *protocol.refits):
        blocks = protocol.blocks if refit == WHOLE else without_benchmarks(protocol.blocks, F.col("bench") == refit)
        blocks = staged(blocks.select("question_id", "bench", "block"))
        count = {r["block"]: r["n"] for r in blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not count.get("eval"):
            raise ValueError("the eval block is empty: nothing to score on")
        if not sum(n for b, n in count.items() if b != "eval"):
            raise ValueError(f"nothing to fit on without {refit!r}")
        sizes[refit] = count
        blocks.select(F.lit(refit).alias("refit"), "*").write.mode("append").parquet(f"{root}/run_blocks")
        own = inputs.cells.join(blocks.where("block <> 'eval'").select("question_id"), "question_id", "left_semi")
        qtext = None if inputs.qtext is None else inputs.qtext.join(blocks.where("block <> 'eval'").select("question_id"), "question_id", "left_semi")
        part = Inputs(staged(own), inputs.plan, qtext, inputs.anstext, inputs.answers, inputs.width)
        _fit_part(part, protocol, refit, root)
    plan = inputs.plan.where(F.col("fold") != FU.NEVER).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(inputs.folds() - 1))))
    side = F.when(F.col("run") == F.col("fold"), "test").otherwise("train")
    plan.select("run", "model_id", side.alias("side")).write.parquet(f"{root}/run_split")
    _describe(spark, root, inputs, protocol, sizes)


def _fit_part(inputs: Inputs, protocol: Protocol, refit: str, root: str) -> None:
    notes = []
    for name in protocol.arms:
        a = ARMS[name]
        for seed in protocol.seeds if a.seeded else (None,):
            reason = _missing(inputs, a)
            if reason is None:
                try:
                    rows = a.fit(inputs, seed or 0).select(*_part({"refit": refit, "arm": name}), F.lit(seed).cast("int").alias("seed"), "*")
                    staged_rows = staged(rows)
                except Exception as e:  # noqa: BLE001  one arm must not sink the others; its row says why
                    reason = f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"
                else:
                    staged_rows.write.mode("append").parquet(f"{root}/run_vectors")
            notes.append((refit, name, seed, reason))
    schema = "refit string, arm string, seed int, reason string"
    inputs.cells.sparkSession.createDataFrame(notes, schema).coalesce(1).write.mode("append").parquet(f"{root}/run_notes")


def _describe(spark: SparkSession, root: str, inputs: Inputs, protocol: Protocol, sizes: dict) -> None:
    """run_arms: one row for each refit, run, seed and arm."""
    notes = spark.read.parquet(f"{root}/run_notes")
    seeds = F.array(*[F.lit(s) for s in protocol.seeds])
    runs = F.sequence(F.lit(0), F.lit(inputs.folds() - 1))
    rows = notes.withColumn("run", F.explode(runs)).withColumn("seed", F.explode(F.when(F.col("seed").isNull(), seeds).otherwise(F.array("seed"))))
    sides = spark.read.parquet(f"{root}/run_split").groupBy("run").agg(
        F.count_if(F.col("side") == "train").alias("n_train"), F.count_if(F.col("side") == "test").alias("n_test")
    )
    counted = [(r, c.get("eval", 0), sum(n for b, n in c.items() if b != "eval")) for r, c in sizes.items()]
    questions = spark.createDataFrame(counted, "refit string, n_eval long, n_fit long")
    made = spark.read.parquet(f"{root}/run_vectors").groupBy("refit", "arm", "run").agg(F.max(F.size("vec")).alias("width"))
    out = rows.join(sides, "run").join(questions, "refit").join(made, ["refit", "arm", "run"], "left")
    status = F.when(F.col("reason").isNull(), "fitted").otherwise("skipped")
    out.select(
        "refit", F.col("run").alias("fold"), "seed", "arm", status.alias("status"), "reason", F.when(F.col("reason").isNull(), F.col("width")).alias("width"),
        "n_train", "n_test", "n_fit", "n_eval",
    ).coalesce(1).write.parquet(f"{root}/run_arms")


def read_runs(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The four tables of a finished protocol, by name; a protocol without an eval block is refused."""
    out = {name: spark.read.parquet(f"{root}/{name}") for name in TABLES}
    if out["run_blocks"].where("block = 'eval'").isEmpty():
        raise ValueError("the protocol records an empty eval block: nothing to score on")
    return out


def score_runs(runs: dict[str, DataFrame], cells: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(refit, arm, seed, run, n_test, sse, sst, r2): how well a run's vectors tell the accuracy of its held-out models.

    The target is a model's mean over the eval cells (of the left-out benchmark, in a refit), ``cells(model_id, question_id,
    acc)``. Each run has its own ridge, fitted on its training side with the strength of the least leave-one-out
    error; all runs share two passes over the vectors, and only sums of the vectors' width reach the driver.
    """
    asked = runs["run_blocks"].where("block = 'eval' and (refit = '' or bench = refit)").select("refit", "question_id")
    target = cells.join(asked, "question_id").groupBy("refit", "model_id").agg(F.avg("acc").alias("y"))
    rows = runs["run_vectors"].join(target, ["refit", "model_id"])
    names = ["refit", "arm", "seed", "run"]
    keys = rows.groupBy(*names).agg(F.count_if(F.col("side") == "test").alias("n_test"))
    numbered = staged(keys.withColumn("key", F.row_number().over(Window.orderBy(*names))))  # one row for each run
    same = (rows["refit"] == numbered["refit"]) & (rows["arm"] == numbered["arm"]) & rows["seed"].eqNullSafe(numbered["seed"]) & (rows["run"] == numbered["run"])
    rows = staged(rows.join(numbered, same).select(numbered["key"], "side", "vec", "y"))
    x = F.concat(F.array(F.lit(1.0)), "vec", F.array("y"))
    fits = {}
    for key, m in FU.keyed_matrices(rows.where("side = 'train'").select(F.col("key").cast("int").alias("key"), x.alias("x")), "key", "x").items():
        n, d = m[0, 0], len(m) - 2
        mu, ybar = m[0, 1 : d + 1] / n, m[0, d + 1] / n
        sd = np.maximum(np.sqrt(np.maximum(np.diag(m)[1 : d + 1] / n - mu**2, 0)), SD_FLOOR)
        g = (m[1 : d + 1, 1 : d + 1] - n * np.outer(mu, mu)) / np.outer(sd, sd)
        c = (m[1 : d + 1, d + 1] - n * mu * ybar) / sd
        inv = np.stack([np.linalg.inv(g + a * np.eye(d)) for a in alphas])
        fits[key] = (n, mu, sd, ybar, inv, inv @ c)

    def errors(batches):
        acc: dict[tuple[int, str], np.ndarray] = {}
        for p in batches:
            for (key, side), part in p.groupby(["key", "side"]):
                if key not in fits:
                    continue
                n, mu, sd, ybar, inv, coef = fits[key]
                z, y = (np.stack(part["vec"].to_list()) - mu) / sd, part["y"].to_numpy()
                e = y[:, None] - ybar - z @ coef.T
                if side == "train":
                    e /= np.maximum(1 - 1 / n - np.stack([((z @ i) * z).sum(1) for i in inv], axis=1), 1e-12)
                    own = (e**2).sum(0)
                else:
                    own = np.concatenate([(e**2).sum(0), [len(y), y.sum(), (y**2).sum()]])
                acc[key, side] = acc.get((key, side), 0) + own
        for (key, side), v in acc.items():
            yield pd.DataFrame({"key": [key], "side": [side], "v": [v]})

    parts = rows.withColumn("key", F.col("key").cast("int")).mapInPandas(errors, "key int, side string, v array<double>")
    long = parts.select("key", "side", F.posexplode("v").alias("i", "v")).groupBy("key", "side", "i").agg(F.sum("v").alias("v"))
    held = long.groupBy("key").agg(
        F.min_by("i", F.when(F.col("side") == "train", F.struct("v", "i"))).alias("best"),
        F.map_from_entries(F.collect_list(F.when(F.col("side") == "test", F.struct("i", "v")))).alias("test"),
    )
    k = len(alphas)
    n, s, q = (F.try_element_at("test", F.lit(k + i)) for i in range(3))
    scored = held.select("key", F.try_element_at("test", F.col("best")).alias("sse"), (q - s * s / n).alias("sst"))
    r2 = F.when((F.col("n_test") >= 2) & (F.col("sst") > 1e-9), 1 - F.col("sse") / F.col("sst"))
    return numbered.join(scored, "key", "left").select("refit", "arm", "seed", "run", "n_test", "sse", "sst", r2.alias("r2"))


def pooled_runs(scores: DataFrame) -> DataFrame:
    """(refit, arm, n_runs, r2, sd, lowest, highest): R2 pooled over a seed's folds, then mean and sample spread over seeds."""
    seed = scores.groupBy("refit", "arm", "seed").agg(
        F.count(F.lit(1)).alias("folds"), F.when(F.sum("sst") > 1e-9, 1 - F.sum("sse") / F.sum("sst")).alias("r2")
    )
    return seed.groupBy("refit", "arm").agg(
        F.sum("folds").alias("n_runs"), F.avg("r2").alias("r2"), F.stddev_samp("r2").alias("sd"), F.min("r2").alias("lowest"), F.max("r2").alias("highest")
    )
