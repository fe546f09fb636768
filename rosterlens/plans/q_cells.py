"""Queries on the cell table: folding, gates, per-benchmark scores, item statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.operators import cells as C
from rosterlens.operators import gates as G
from rosterlens.plans.common_sql import CELLS, DRAWS, MODELS, QUESTIONS
from rosterlens.plans.registry import SETTLE, query
from rosterlens.sources import tables as T

COVER = (
    CELLS
    + ", "
    + QUESTIONS
    + ", "
    + MODELS
    + """, cover AS (
  SELECT m.*, coalesce(answered, 0) AS answered,
         coalesce(answered, 0)::DOUBLE / (SELECT count(*) FROM questions) AS coverage,
         coalesce(n_correct::DOUBLE / answered, 0) AS accuracy
  FROM models m LEFT JOIN (SELECT model_id, count(*) AS answered, sum(correct) AS n_correct
                           FROM cells GROUP BY 1) USING (model_id))"""
)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison; summation order differs between engines in the last bits."""
    return df.withColumns({n: near(n, digits) for n in names})


def near(x, digits: int = 6):
    return F.round(F.round(x, digits + SETTLE), digits) + F.lit(0.0)  # no negative zero


def coverage(spark, sf):
    return C.model_coverage(T.cells(spark, sf), T.models(spark, sf), T.questions(spark, sf))


@query(
    "cell_fold",
    f"WITH {CELLS} SELECT model_id, question_id, bench, round(acc, 6) AS acc, correct, draws FROM cells",
)
def cell_fold(spark, sf):
    return rounded(T.cells(spark, sf), "acc")


@query(
    "row_accuracy",
    f"WITH {COVER} SELECT model_id, answered, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy FROM cover",
)
def row_accuracy(spark, sf):
    return rounded(coverage(spark, sf).select("model_id", "answered", "coverage", "accuracy"), "coverage", "accuracy")


@query(
    "slug_gate",
    """SELECT s_suppkey AS model_id, s_name AS name,
         CASE WHEN contains(lower(s_name), '00007') OR contains(lower(s_name), 'r#00000000') THEN 'bad slug' END AS reason
       FROM supplier""",
)
def slug_gate(spark, sf):
    return G.slug_gate(T.models(spark, sf), "name", ("00007", "R#00000000")).select("model_id", "name", "reason")


@query(
    "assembly_coverage_gate",
    f"WITH {COVER} SELECT model_id, round(coverage, 6) AS coverage FROM cover WHERE coverage >= 0.99",
)
def assembly_coverage_gate(spark, sf):
    return rounded(G.coverage_gate(coverage(spark, sf)).select("model_id", "coverage"), "coverage")


QC = """, flags AS (
  SELECT model_id, coverage, accuracy,
    CASE WHEN coverage < {floor} THEN
           CASE WHEN coverage = 0 THEN 'no responses collected'
                ELSE 'coverage ' || printf('%.2f%%', coverage * 100) || ' below the {pct} floor' END
         WHEN accuracy = 0 THEN 'zero valid outputs across all covered cells' END AS dropped,
    concat_ws('; ',
      CASE WHEN n_rows = 0 THEN 'no rows in the response logs' END,
      CASE WHEN n_rows > 0 AND n_empty = n_rows THEN 'every response was empty'
           WHEN n_rows > 0 AND n_empty::DOUBLE / n_rows > 0.5
           THEN printf('%.1f%%', n_empty::DOUBLE / n_rows * 100) || ' of responses were empty' END,
      CASE WHEN accuracy <= {deg} THEN 'accuracy ' || printf('%.2f%%', accuracy * 100)
           || ' at or below the degenerate-accuracy gate' END) AS flagged
  FROM logged)
SELECT model_id, CASE WHEN dropped IS NOT NULL THEN 'dropped' WHEN flagged <> '' THEN 'flagged' ELSE 'kept' END AS status,
       coalesce(dropped, flagged) AS reasons, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy
FROM flags"""


def _logged(spark, sf):
    """Coverage plus logged and blank draws; a draw with a tax of 0.04 or more has a blank response here."""
    log = (
        T.table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("model_id"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum((F.col("l_tax") >= 0.04).cast("bigint")).alias("n_empty"))
    )
    return coverage(spark, sf).join(log, "model_id", "left").fillna(0, ["n_rows", "n_empty"])


LOGGED = (
    COVER
    + """, logged AS (
  SELECT c.*, coalesce(n_rows, 0) AS n_rows, coalesce(n_empty, 0) AS n_empty
  FROM cover c LEFT JOIN (SELECT l_suppkey AS model_id, count(*) AS n_rows, sum((l_tax >= 0.04)::INT) AS n_empty
                          FROM lineitem GROUP BY 1) USING (model_id))"""
)


@query("quality_report", "WITH " + LOGGED + QC.format(floor=0.97, pct="97%", deg=0.38))
def quality_report(spark, sf):
    """Coverage floor, zero-output gate and suspicion flags in one pass (levels set to bite here)."""
    return rounded(G.quality_report(_logged(spark, sf), 0.97, 0.38), "coverage", "accuracy")


@query(
    "qc_totals",
    f"""WITH {COVER} SELECT count(*) AS n_models_in, count(*) FILTER (kept) AS n_models_kept,
     round(sum(answered) / (count(*) * any_value(nq)), 6) AS overall_coverage,
     round(coalesce(min(coverage) FILTER (kept), 0), 6) AS min_kept_coverage,
     (sum(nq - answered) FILTER (kept))::BIGINT AS uncovered_written_as_incorrect
     FROM (SELECT *, coverage >= 0.9 AND accuracy > 0 AS kept, (SELECT count(*) FROM questions) AS nq FROM cover)""",
)
def qc_totals(spark, sf):
    kept = (F.col("coverage") >= G.COVERAGE_FLOOR) & (F.col("accuracy") > 0)
    nq = T.questions(spark, sf).agg(F.count(F.lit(1))).scalar()
    out = coverage(spark, sf).withColumn("nq", nq).agg(
        F.count(F.lit(1)).alias("n_models_in"),
        F.count_if(kept).alias("n_models_kept"),
        (F.sum("answered") / (F.count(F.lit(1)) * F.max("nq"))).alias("overall_coverage"),
        F.coalesce(F.min(F.when(kept, F.col("coverage"))), F.lit(0.0)).alias("min_kept_coverage"),
        F.sum(F.when(kept, F.col("nq") - F.col("answered"))).alias("uncovered_written_as_incorrect"),
    )
    return rounded(out, "overall_coverage", "min_kept_coverage")


@query(
    "degenerate_drop",
    f"WITH {COVER} SELECT model_id, round(accuracy, 6) AS accuracy FROM cover WHERE accuracy > 0.36",
)
def degenerate_drop(spark, sf):
    return rounded(G.drop_degenerate(coverage(spark, sf), 0.36).select("model_id", "accuracy"), "accuracy")


@query(
    "core_view",
    f"""WITH {CELLS}, {QUESTIONS}, {MODELS}, core AS (SELECT question_id FROM questions WHERE bench IN ('ECONOMY', 'SMALL', 'PROMO')),
    got AS (SELECT model_id, sum(correct) AS r, count(*) AS n FROM cells SEMI JOIN core USING (question_id) GROUP BY 1)
    SELECT model_id, round(coalesce(r, 0) / (SELECT count(*) FROM core), 6) AS core_accuracy,
           (SELECT count(*) FROM core) - coalesce(n, 0) AS written_as_incorrect
    FROM models LEFT JOIN got USING (model_id)""",
)
def core_view(spark, sf):
    core = T.questions(spark, sf).filter(F.col("bench").isin("ECONOMY", "SMALL", "PROMO"))
    return rounded(G.core_view(T.cells(spark, sf), core, core.agg(F.count(F.lit(1))).scalar(), T.models(spark, sf)), "core_accuracy")


@query(
    "fullset_view",
    f"""WITH {COVER} SELECT c.model_id, c.question_id, c.correct FROM cells c
    WHERE model_id IN (SELECT model_id FROM cover WHERE answered = (SELECT count(*) FROM questions))""",
)
def fullset_view(spark, sf):
    """Cells of the models that answered everything; gap-free by construction."""
    full = G.coverage_gate(coverage(spark, sf), 1.0)
    return T.cells(spark, sf).join(full, "model_id", "left_semi").select("model_id", "question_id", "correct")


@query(
    "slice_summary",
    f"""WITH {COVER} SELECT (SELECT count(*) FROM models) AS n_models, (SELECT count(*) FROM questions) AS n_questions,
      (SELECT count(DISTINCT bench) FROM questions) AS n_benchmarks,
      (SELECT count(*) FROM cells) AS n_covered,
      round((SELECT count(*) FROM cells) / ((SELECT count(*) FROM models) * (SELECT count(*) FROM questions)), 6) AS coverage,
      round((SELECT avg(correct) FROM cells), 6) AS mean_accuracy,
      (SELECT count(*) FROM cover WHERE coverage = 1) AS n_fullset,
      (SELECT count(*) FROM models WHERE vram_gb IS NOT NULL) AS n_with_vram""",
)
def slice_summary(spark, sf):
    cov = coverage(spark, sf)
    q = T.questions(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("bench").alias("b"))
    nq, nb = q.select("n").scalar(), q.select("b").scalar()
    acc = T.cells(spark, sf).agg(F.avg("correct")).scalar()
    out = cov.agg(
        F.count(F.lit(1)).alias("n_models"),
        F.sum("answered").alias("n_covered"),
        F.count_if(F.col("coverage") == 1).alias("n_fullset"),
        F.count("vram_gb").alias("n_with_vram"),
    )
    out = out.select(
        "*",
        nq.alias("n_questions"),
        nb.alias("n_benchmarks"),
        (F.col("n_covered") / (F.col("n_models") * nq)).alias("coverage"),
        acc.alias("mean_accuracy"),
    )
    return rounded(out, "coverage", "mean_accuracy")


@query(
    "benchmark_scores",
    f"""WITH {CELLS} SELECT model_id, bench, round(avg(acc), 6) AS score, count(*) AS n
    FROM cells GROUP BY ROLLUP (model_id, bench) HAVING model_id IS NOT NULL""",
)
def benchmark_scores(spark, sf):
    return rounded(C.benchmark_scores(T.cells(spark, sf)), "score")


@query(
    "benchmark_matrix",
    f"""WITH {CELLS}, s AS (SELECT model_id, bench, avg(acc) AS a FROM cells GROUP BY ALL)
    SELECT model_id, round(max(a) FILTER (bench = 'ECONOMY'), 6) AS economy, round(max(a) FILTER (bench = 'LARGE'), 6) AS large,
     round(max(a) FILTER (bench = 'MEDIUM'), 6) AS medium, round(max(a) FILTER (bench = 'PROMO'), 6) AS promo,
     round(max(a) FILTER (bench = 'SMALL'), 6) AS small, round(max(a) FILTER (bench = 'STANDARD'), 6) AS standard
    FROM s GROUP BY 1""",
)
def benchmark_matrix(spark, sf):
    """Model by benchmark matrix of mean accuracies; the benchmark names are part of the query."""
    names = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    wide = T.cells(spark, sf).groupBy("model_id").pivot("bench", names).agg(F.avg("acc"))
    return wide.select("model_id", *[near(n).alias(n.lower()) for n in names])


@query(
    "leaderboard_gated",
    f"""WITH {COVER}, kept AS (SELECT model_id FROM cover WHERE coverage >= 0.9 AND accuracy > 0),
    s AS (SELECT model_id, round(avg(acc), 9) AS score, count(*) AS n_questions FROM cells SEMI JOIN kept USING (model_id) GROUP BY 1)
    SELECT *, rank() OVER (ORDER BY score DESC) AS rank FROM s""",
)
def leaderboard_gated(spark, sf):
    """End to end: draws -> cells -> gates -> mean accuracy -> rank."""
    cells = T.cells(spark, sf)
    kept = G.quality_report(coverage(spark, sf)).filter(F.col("status") != "dropped")
    return C.leaderboard(cells.join(kept, "model_id", "left_semi"))


@query(
    "question_difficulty",
    f"""WITH {CELLS} SELECT question_id, bench, round(avg(acc), 6) AS p, round(avg(correct), 6) AS bit_rate,
    count(*) AS n_models, sum(draws)::BIGINT AS n_draws FROM cells GROUP BY ALL""",
)
def question_difficulty(spark, sf):
    out = T.cells(spark, sf).groupBy("question_id", "bench").agg(
        F.avg("acc").alias("p"),
        F.avg("correct").alias("bit_rate"),
        F.count(F.lit(1)).alias("n_models"),
        F.sum("draws").alias("n_draws"),
    )
    return rounded(out, "p", "bit_rate")


LOO = (
    CELLS
    + """, loo AS (
  SELECT c.*, (sum(acc) OVER w - acc) / nullif(count(*) OVER w - 1, 0) AS theta
  FROM cells c WINDOW w AS (PARTITION BY model_id))"""
)


@query(
    "loo_ability",
    f"WITH {LOO} SELECT model_id, question_id, round(theta, 6) AS theta FROM loo",
)
def loo_ability(spark, sf):
    return rounded(C.loo_ability(T.cells(spark, sf)).select("model_id", "question_id", "theta"), "theta")


@query(
    "item_statistics",
    f"""WITH {LOO}, s AS (SELECT question_id, avg(acc) AS p, count(*) AS n_models,
      CASE WHEN count(*) >= 2 AND stddev_pop(acc) >= 1e-9 AND stddev_pop(theta) >= 1e-9 THEN corr(acc, theta) END AS d
      FROM loo GROUP BY 1)
    SELECT question_id, round(p, 6) AS p, n_models, round(d, 6) AS discrimination, round(d * d * p * (1 - p), 6) AS fisher FROM s""",
)
def item_statistics(spark, sf):
    return rounded(C.item_statistics(T.cells(spark, sf)), "p", "discrimination", "fisher")


@query(
    "benchmark_index",
    f"WITH {QUESTIONS} SELECT question_id, bench, (dense_rank() OVER (ORDER BY bench) - 1)::INT AS bench_ix FROM questions",
)
def benchmark_index(spark, sf):
    return C.dense_bench_index(T.questions(spark, sf)).select("question_id", "bench", "bench_ix")


@query(
    "last_result_wins",
    f"""WITH {DRAWS} SELECT model_id, question_id, arg_max(correct, order_id * 8 + line_no) AS correct,
        max(order_id * 8 + line_no) AS at, count(*) AS n_rows FROM draws GROUP BY 1, 2""",
)
def last_result_wins(spark, sf):
    """Of several graded rows for one cell the last written one counts."""
    at = F.col("order_id") * 8 + F.col("line_no")
    return (
        T.draws(spark, sf)
        .groupBy("model_id", "question_id")
        .agg(F.max_by("correct", at).alias("correct"), F.max(at).alias("at"), F.count(F.lit(1)).alias("n_rows"))
    )


@query(
    "collected_models",
    "SELECT DISTINCT l_suppkey AS model_id FROM lineitem ORDER BY 1",
)
def collected_models(spark, sf):
    return T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("model_id")).distinct().orderBy("model_id")
