"""A whole run: fit every arm on the fitting blocks, score it on the eval block, attach the random floor."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.operators import embed as E
from rosterlens.operators import scores as S
from rosterlens.operators.splits import gaussian_floor
from rosterlens.operators.tasks import TASKS, Bench, run_tasks
from rosterlens.session import cut_lineage

Arm = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


def arms(width: int, seed: int, models: DataFrame) -> dict[str, Arm]:
    """Arm name -> embedding(model_id, vec) of (centred bits, text, training models)."""
    half = E.block_widths(width, 2)

    def floor(bits: DataFrame, text: DataFrame, train: DataFrame) -> DataFrame:
        table = gaussian_floor(models, width, 1, seed)
        return table.groupBy("model_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("vec")
        )

    return {
        "pls_fusion": lambda bits, text, train: E.pls_svd(bits, text, (half[0], half[1]), train),
        "text_only": lambda bits, text, train: text.select("model_id", F.col("emb").alias("vec")),
        f"null_random{width}": floor,
    }


def select_tasks(names: Sequence[str] | None = None, groups: Sequence[str] | None = None) -> list[str]:
    """Task names by name and/or group; an unknown name or group is an error."""
    unknown = sorted(set(names or ()) - set(TASKS)) + sorted(set(groups or ()) - {t.group for t in TASKS.values()})
    if unknown:
        raise ValueError(f"unknown tasks or groups: {unknown}")
    return [n for n, t in TASKS.items() if (names is None or n in names) and (groups is None or t.group in groups)]


def fit_arms(fit_cells: DataFrame, text: DataFrame, train: DataFrame, models: DataFrame, width: int, seed: int) -> dict[str, DataFrame]:
    """Every arm fitted on the same bits and text; fitted tables are written once."""
    bits = cut_lineage(E.center_bits(fit_cells, train))
    text = cut_lineage(text.select("model_id", "emb"))
    return {name: cut_lineage(fit(bits, text, train)) for name, fit in arms(width, seed, models).items()}


def check_no_leak(fit_cells: DataFrame, eval_cells: DataFrame) -> None:
    """An arm fitted on an evaluation question is refused."""
    leaked = fit_cells.select("question_id").distinct().join(eval_cells, "question_id", "left_semi").limit(3).collect()
    if leaked:
        raise ValueError(f"fitted on evaluation questions: {[r[0] for r in leaked]}")


def score_arms(bench: Bench, fitted: dict[str, DataFrame], names: Sequence[str], width: int) -> DataFrame:
    """results(method, task, grp, s, floor_arm, floor_s, s_over_floor) of every arm's primary metric."""
    out = None
    shared = dict(bench.cache)
    for method, vec in fitted.items():
        # what does not depend on the embedding is made once for all arms
        shared.pop("decoded", None)
        rows = run_tasks(replace(bench, embedding=vec, cache=shared), list(names)).withColumn("method", F.lit(method))
        out = rows if out is None else out.unionByName(rows)
    primary = F.lit(False)
    for n in names:
        primary = primary | ((F.col("task") == n) & (F.col("metric") == TASKS[n].primary))
    rows = cut_lineage(
        out.filter(primary).select("method", "task", F.lit("").alias("grp"), F.col("value").alias("s"), F.lit(width).alias("dim"))
    )
    draws = S.floor_spread(rows.filter(F.startswith("method", F.lit("null_random"))))
    return S.attach_floor(rows, draws)
