"""Queries on whole protocols: every arm at every fold and seed, refits, the manifest and the scores."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rosterlens.operators import fusion as FU
from rosterlens.operators import runs as RN
from rosterlens.operators import splits as P
from rosterlens.plans.common_sql import CELLS, MODELS
from rosterlens.plans.q_cells import rounded
from rosterlens.plans.q_splits import BLOCKS, FOLDS, blocks
from rosterlens.plans.q_vectors import pooled, question_emb, rounded_vec
from rosterlens.plans.registry import query
from rosterlens.session import cut_lineage, drop_at_end, shared_folder
from rosterlens.sources import tables as T

#: The protocol of these queries. The last arm lacks its input here, which the manifest has to say.
WIDTH, SEEDS, LEFT_OUT = 8, (0, 1, 2), "PROMO"
ARMS = {
    "pls_bits_qtext": 8,
    "pls_bits_anstext": 8,
    "pls_qtext_anstext": 8,
    "pls_bits_qtext_anstext": 8,
    "pls_shuffled_anstext": 8,
    "text_only": 64,
    "null_random": 8,
    "random_fingerprint": None,
}

_DONE: dict[tuple[str, str], str] = {}


def inputs(spark, sf) -> RN.Inputs:
    return RN.Inputs(
        T.cells(spark, sf), cut_lineage(P.k_folds(T.models(spark, sf), 5, 7)), question_emb(spark, sf), cut_lineage(pooled(spark, sf)), width=WIDTH
    )


def protocol(spark, sf) -> dict:
    """The tables of the fitted protocol; fitted once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _DONE:
        root = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
        RN.fit_runs(inputs(spark, sf), RN.Protocol(blocks(spark, sf), list(ARMS), SEEDS, (LEFT_OUT,)), root)
        drop_at_end(spark, root)
        _DONE[key] = root
    return RN.read_runs(spark, _DONE[key])


_ARM_ROWS = ", ".join(f"('{a}', {w if w else 'NULL'}, {'NULL' if w else chr(39) + 'no input: answers' + chr(39)})" for a, w in ARMS.items())
_SIDES = "sides AS (SELECT model_id, unnest(range(5))::INT AS run, fold FROM folds)"


@query(
    "run_manifest",
    f"""WITH {MODELS}, {FOLDS}, {BLOCKS}, {_SIDES}, arms(arm, width, reason) AS (VALUES {_ARM_ROWS}),
    n AS (SELECT run, count(*) FILTER (fold <> run) AS n_train, count(*) FILTER (fold = run) AS n_test FROM sides GROUP BY 1),
    q AS (SELECT refit, count(*) FILTER (block <> 'eval' AND bench <> refit) AS n_fit, count(*) FILTER (block = 'eval') AS n_eval
      FROM blocks, (VALUES (''), ('{LEFT_OUT}')) AS r(refit) GROUP BY 1)
    SELECT refit, run AS fold, seed, arm, CASE WHEN reason IS NULL THEN 'fitted' ELSE 'skipped' END AS status, reason, width::INT AS width, n_train, n_test, n_fit, n_eval
    FROM n, q, arms, (SELECT unnest([0, 1, 2])::INT AS seed)""",
)
def run_manifest(spark, sf):
    """What was fitted in every run and what was skipped, and why."""
    return protocol(spark, sf)["run_arms"]


@query("run_split_table", f"WITH {MODELS}, {FOLDS}, {_SIDES} SELECT run, model_id, CASE WHEN fold = run THEN 'test' ELSE 'train' END AS side FROM sides")
def run_split_table(spark, sf):
    return protocol(spark, sf)["run_split"]


@query(
    "run_blocks_table",
    f"""WITH {BLOCKS} SELECT refit, question_id, bench, block FROM blocks, (VALUES (''), ('{LEFT_OUT}')) AS r(refit)
    WHERE NOT (block <> 'eval' AND bench = refit)""",
)
def run_blocks_table(spark, sf):
    """The questions of each block, for the whole fit and the refit without a benchmark."""
    return protocol(spark, sf)["run_blocks"].select("refit", "question_id", "bench", "block")


@query("run_scores")
def run_scores(spark, sf):
    """How well each arm tells the eval accuracy of models it was not fitted on, pooled over folds, then over seeds."""
    scores = RN.score_runs(protocol(spark, sf), T.cells(spark, sf))
    return rounded(RN.pooled_runs(scores), "r2", "sd", "lowest", "highest")


@query(
    "fold_sums",
    f"""WITH {MODELS}, {FOLDS}, {_SIDES}, {CELLS}
    SELECT question_id, run, count(*) AS n, sum(correct)::BIGINT AS right, round(avg(correct), 6) AS mean
    FROM cells JOIN sides USING (model_id) WHERE fold <> run GROUP BY 1, 2""",
)
def fold_sums(spark, sf):
    """Every run's question counts and means as the total of all folds less its own."""
    i = inputs(spark, sf)
    sums = FU.run_sums(FU.fold_sums(i.cells, i.plan, None, 0), i.folds())
    n, right = F.col("total")[0], F.col("total")[1]
    out = sums.where(n > 0).select("question_id", "run", n.cast("bigint").alias("n"), right.cast("bigint").alias("right"), (right / n).alias("mean"))
    return rounded(out, "mean")


@query("pls_three_blocks")
def pls_three_blocks(spark, sf):
    """Bits, question text and answer text fused at widths 4 / 2 / 2, every model in every run of five folds."""
    return rounded_vec(FU.pls(inputs(spark, sf).gathered(), FU.CHANNELS, WIDTH), "vec", 5)


@query("pca_channels")
def pca_channels(spark, sf):
    """Components of the three channels side by side, for five folds at once."""
    return rounded_vec(FU.channel_components(inputs(spark, sf).gathered(), FU.CHANNELS, 4), "vec", 4)
