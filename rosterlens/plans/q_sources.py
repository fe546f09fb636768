"""Queries that write result tables of the given data to storage and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.operators import splits as P
from rosterlens.plans.common_sql import CELLS, DRAWS, MODELS, RESPONSES
from rosterlens.plans.q_cells import near, rounded
from rosterlens.plans.q_splits import BLOCKS, FOLDS, blocks
from rosterlens.plans.q_stream import scratch
from rosterlens.plans.registry import query
from rosterlens.sources import files as S
from rosterlens.sources import tables as T


@query(
    "results_roundtrip",
    f"""WITH {DRAWS} SELECT model_id, count(*) AS n, sum(correct)::BIGINT AS n_correct, count(DISTINCT question_id) AS n_questions FROM draws GROUP BY 1""",
)
def results_roundtrip(spark, sf):
    """Graded rows written as JSON per model and read back."""
    folder = scratch(spark) + "/results"
    S.write_results(T.draws(spark, sf).select("model_id", "question_id", "correct", "part_id"), folder, "part_id")
    back = spark.read.schema("question_id string, correct int, part_id bigint, model_id bigint").json(folder)
    return back.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("correct").alias("n_correct"), F.countDistinct("question_id").alias("n_questions")
    )


@query(
    "slice_roundtrip",
    f"""WITH {CELLS} SELECT bench, count(*) AS n_cells, sum(correct)::BIGINT AS n_correct, round(sum(acc), 6) AS total, sum(draws)::BIGINT AS n_draws FROM cells GROUP BY 1""",
)
def slice_roundtrip(spark, sf):
    """The cell table written as Parquet by benchmark; the read prunes to the columns it sums."""
    folder = scratch(spark) + "/cells"
    S.write_table(T.cells(spark, sf), folder, ["bench"])
    out = spark.read.parquet(folder).groupBy("bench").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("correct").alias("n_correct"), F.sum("acc").alias("total"), F.sum("draws").alias("n_draws")
    )
    return rounded(out, "total")


@query("plan_roundtrip", f"WITH {MODELS}, {FOLDS} SELECT fold, count(*) AS n, min(model_id) AS lo, max(model_id) AS hi FROM folds GROUP BY 1")
def plan_roundtrip(spark, sf):
    """A fold plan stored and resolved against the model axis."""
    folder = scratch(spark) + "/plan"
    models = T.models(spark, sf).select("model_id")
    S.write_table(P.k_folds(models, 5, 7), folder)
    plan = S.read_plan(spark, folder, models)
    return plan.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.min("model_id").alias("lo"), F.max("model_id").alias("hi"))


@query("blocks_roundtrip", f"WITH {BLOCKS} SELECT block, bench, count(*) AS n FROM blocks GROUP BY 1, 2")
def blocks_roundtrip(spark, sf):
    folder = scratch(spark) + "/blocks"
    S.write_table(blocks(spark, sf), folder, ["block"])
    return spark.read.parquet(folder).groupBy("block", "bench").agg(F.count(F.lit(1)).alias("n"))


@query(
    "csv_sink",
    f"""WITH {CELLS} SELECT bench, count(*)::VARCHAR AS n, round(avg(acc), 6)::VARCHAR AS score FROM cells GROUP BY 1""",
)
def csv_sink(spark, sf):
    """A score table through CSV: every value comes back as the text that was written."""
    folder = scratch(spark) + "/csv"
    out = T.cells(spark, sf).groupBy("bench").agg(F.count(F.lit(1)).alias("n"), near(F.avg("acc")).alias("score"))
    S.write_csv(out, folder)
    return spark.read.schema("bench string, n string, score string").option("header", "true").csv(folder)


@query(
    "input_contract",
    f"""WITH {CELLS}, {MODELS} SELECT 'duplicate cell' AS violation, count(*) AS n FROM (SELECT 1 FROM cells GROUP BY model_id, question_id HAVING count(*) > 1)
    UNION ALL SELECT 'unknown model', count(*) FROM cells ANTI JOIN models USING (model_id)
    UNION ALL SELECT 'accuracy out of range', count(*) FROM cells WHERE acc IS NULL OR isnan(acc) OR acc < 0 OR acc > 1
    UNION ALL SELECT 'size not finite', count(*) FROM models WHERE params_b IS NULL""",
)
def input_contract(spark, sf):
    """Contract checks of the input tables: how many rows break each rule."""
    c, m = T.cells(spark, sf), T.models(spark, sf)
    one = F.count(F.lit(1)).alias("n")
    checks = {
        "duplicate cell": c.groupBy("model_id", "question_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").agg(one),
        "unknown model": c.join(m, "model_id", "left_anti").agg(one),
        "accuracy out of range": c.filter("acc IS NULL OR isnan(acc) OR acc < 0 OR acc > 1").agg(one),
        "size not finite": m.filter("params_b IS NULL").agg(one),
    }
    out = None
    for name, df in checks.items():
        row = df.select(F.lit(name).alias("violation"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query(
    "leak_guard",
    f"""WITH {BLOCKS} SELECT count(*) FILTER (block = 'eval') AS n_eval, (SELECT count(*) FROM (SELECT question_id FROM blocks WHERE block <> 'eval' INTERSECT SELECT question_id FROM blocks WHERE block = 'eval')) AS n_leaked FROM blocks""",
)
def leak_guard(spark, sf):
    """No fitted question may be an evaluation question."""
    b = blocks(spark, sf)
    leaked = b.filter("block <> 'eval'").select("question_id").intersect(b.filter("block = 'eval'").select("question_id"))
    return b.agg(F.count_if(F.col("block") == "eval").alias("n_eval")).withColumn("n_leaked", leaked.agg(F.count(F.lit(1))).scalar())


@query(
    "placement_guard",
    f"""WITH {MODELS}, {FOLDS} SELECT (SELECT count(*) FROM models ANTI JOIN folds USING (model_id)) AS only_models, (SELECT count(*) FROM folds ANTI JOIN models USING (model_id)) AS only_plan""",
)
def placement_guard(spark, sf):
    """The placed rows must name the same models as the axis."""
    m = T.models(spark, sf).select("model_id", F.lit(1).alias("a"))
    f = P.k_folds(T.models(spark, sf), 5, 7).select("model_id", F.lit(1).alias("b"))
    return m.join(f, "model_id", "full_outer").agg(
        F.count_if(F.col("b").isNull()).alias("only_models"), F.count_if(F.col("a").isNull()).alias("only_plan")
    )


@query(
    "response_log",
    f"""WITH {RESPONSES} SELECT model_id, count(*) AS n_rows, sum((length(trim(prediction)) < 20)::INT)::BIGINT AS n_short FROM responses GROUP BY 1""",
)
def response_log(spark, sf):
    """Rows and short responses per model's log."""
    return T.responses(spark, sf).groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum((F.length(F.trim("prediction")) < 20).cast("bigint")).alias("n_short")
    )


