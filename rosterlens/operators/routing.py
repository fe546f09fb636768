"""Which answer protocol grades a (benchmark, model) pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.operators.gates import contains_any

# Fixed values of the routing tables.
BENCH_ADAPTER = {
    "mmlu": "mcq",
    "mmlu_pro": "mcq",
    "mmlu_med": "mcq",
    "arc_challenge": "mcq",
    "hellaswag": "mcq",
    "winogrande": "mcq",
    "musr": "mcq",
    "truthfulqa": "mcq",
    "medqa": "mcq",
    "medmcqa": "mcq",
    "piqa": "mcq",
    "social_iqa": "mcq",
    "logiqa": "mcq",
    "mathqa": "mcq",
    "aime_2024": "free",
    "pubmedqa": "free",
    "asdiv": "free",
    "humaneval": "code",
    "mbpp": "code",
    "ifeval": "ifeval",
    "gpqa_diamond": "mcq",
    "gpqa_extended": "mcq",
    "gpqa_main": "mcq",
    "math": "legacy",
    "gpqa": "legacy",
    "bbh": "legacy",
    "gsm8k": "legacy",
}
PREFIX_PARENT = {"mmlu_": "mmlu", "gpqa_": "gpqa"}
REASONING_VARIANT = {"mcq": "mcq_think", "free": "free_think"}
ITEM_FORMATS = ("mcq", "free", "code", "ifeval")
LEGACY = ("gsm8k", "math", "gpqa", "bbh")
REASONING_MARKERS = (
    "r1-distill",
    "deepseek-r1",
    "qwen3",
    "qwq",
    "reasoning",
    "nemotron",
    "magistral",
    "openthinker",
    "sky-t1",
    "skywork-or1",
    "mimo",
    "s1.1",
    "exaone-deep",
    "glm-z1",
    "marco-o1",
)
THINKING_BUDGET = (12288, 0.6)
STANDARD_BUDGET = (3072, 0.0)


def model_class(model: str, markers: Sequence[str] = REASONING_MARKERS) -> Column:
    return F.when(contains_any(model, markers), "@reasoning").when(
        F.length(model) > 0, "@instruct"
    )


def generation_budget(model: str, markers: Sequence[str]) -> Column:
    """struct(max_new_tokens, temperature)."""
    long, short = (
        F.struct(F.lit(n).alias("max_new_tokens"), F.lit(t).alias("temperature"))
        for n, t in (THINKING_BUDGET, STANDARD_BUDGET)
    )
    return F.when(contains_any(model, markers), long).otherwise(short)


def routing_table(spark: SparkSession) -> DataFrame:
    """routes(bench, adapter): a fixed table of a few dozen rows."""
    return spark.createDataFrame(list(BENCH_ADAPTER.items()), "bench string, adapter string")


def _prefix_parent(bench: str) -> Column:
    out = F.lit(None).cast("string")
    for prefix, parent in PREFIX_PARENT.items():
        out = F.when(F.col(bench).startswith(prefix), parent).otherwise(out)
    return out


def resolve(df: DataFrame, bench: str, model: str, markers: Sequence[str] = REASONING_MARKERS, fmt: str | None = None) -> DataFrame:
    """Adds ``adapter`` and ``routed``.

    Exact benchmark entry, else the parent of a known prefix, else ``legacy`` for a legacy name,
    else ``free``. Reasoning models read the think variant. An item's own format wins, except on
    legacy benchmarks. The routing table has a fixed size, so the joins are broadcast.
    """
    exact = F.broadcast(routing_table(df.sparkSession).withColumnsRenamed({"bench": bench, "adapter": "__exact"}))
    parent = F.broadcast(routing_table(df.sparkSession).withColumnsRenamed({"bench": "__parent", "adapter": "__inherit"}))
    out = (
        df.withColumn("__parent", _prefix_parent(bench))
        .join(exact, bench, "left")
        .join(parent, "__parent", "left")
    )
    entry = F.coalesce("__exact", "__inherit")
    base = F.coalesce(entry, F.when(F.col(bench).isin(*LEGACY), "legacy"), F.lit("free"))
    thinks = entry.isNotNull() & (model_class(model, markers) == "@reasoning")
    for plain, variant in REASONING_VARIANT.items():
        base = F.when(thinks & (entry == plain), variant).otherwise(base)
    out = out.withColumn("__table", base).withColumn("routed", entry.isNotNull().cast("int"))
    if fmt is None:
        final = F.col("__table")
    else:
        family = F.regexp_replace("__table", "_think$", "")
        keep_think = F.col("__table").endswith("_think") & F.col(fmt).isin(*REASONING_VARIANT)
        final = F.when(
            (F.col("__table") != "legacy") & F.col(fmt).isin(*ITEM_FORMATS) & (F.col(fmt) != family),
            F.when(keep_think, F.concat(F.col(fmt), F.lit("_think"))).otherwise(F.col(fmt)),
        ).otherwise(F.col("__table"))
    return out.withColumn("adapter", final).drop("__parent", "__exact", "__inherit", "__table")
