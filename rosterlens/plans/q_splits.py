"""Queries on splits, samples, permutations and rank statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.functions import ranks as R
from rosterlens.functions.draws import draw_index, normal_sql
from rosterlens.operators import cells as C
from rosterlens.operators import gates as G
from rosterlens.operators import selection as K
from rosterlens.operators import splits as P
from rosterlens.plans.common_sql import CELLS, MODELS, QUESTIONS, h
from rosterlens.plans.q_cells import COVER, LOO, coverage, rounded
from rosterlens.plans.registry import query
from rosterlens.sources import tables as T

# Sizes of the cut used by the queries: the given question axis has 106 to 150 questions.
EVAL, TUNE, SEED = 40, 30, 7


def strat(src: str, size: int, purpose: str, out: str) -> str:
    return f"""{out}_p AS (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY {h(f"'{SEED}'", f"'{purpose}'", 'question_id')}, question_id) AS pos,
        greatest(round_even({size} * count(*) OVER (PARTITION BY bench)::DOUBLE / (SELECT count(*) FROM {src}), 0), 1) AS quota FROM {src}),
      {out} AS (SELECT question_id, bench FROM {out}_p WHERE pos <= quota
        ORDER BY {h(f"'{SEED}'", f"'{purpose}-trim'", 'question_id')}, question_id LIMIT {size})"""


BLOCKS = f"""{QUESTIONS}, {strat('questions', EVAL, 'eval', 'ev')},
  rest AS (SELECT * FROM questions ANTI JOIN ev USING (question_id)), {strat('rest', TUNE, 'tune', 'tu')},
  blocks AS (SELECT *, 'eval' AS block FROM ev UNION ALL SELECT *, 'tune' FROM tu
             UNION ALL SELECT *, 'pool' FROM rest ANTI JOIN tu USING (question_id))"""


def blocks(spark, sf):
    return P.question_blocks(T.questions(spark, sf), EVAL, TUNE, SEED)


@query("stratified_sample", f"WITH {QUESTIONS}, {strat('questions', EVAL, 'eval', 'ev')} SELECT question_id, bench FROM ev")
def stratified_sample(spark, sf):
    return P.stratified_sample(T.questions(spark, sf), EVAL, SEED, "eval")


@query("question_blocks", f"WITH {BLOCKS} SELECT question_id, bench, block FROM blocks")
def question_blocks(spark, sf):
    return blocks(spark, sf).select("question_id", "bench", "block")


@query(
    "block_partition_check",
    f"""WITH {BLOCKS} SELECT count(*) AS n, count(DISTINCT question_id) AS n_distinct,
       (SELECT count(*) FROM questions) AS n_questions,
       count(*) FILTER (block = 'eval') AS n_eval, count(*) FILTER (block = 'tune') AS n_tune,
       count(*) FILTER (block = 'pool') AS n_pool FROM blocks""",
)
def block_partition_check(spark, sf):
    """The three blocks must cover the axis exactly once."""
    out = blocks(spark, sf).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("question_id").alias("n_distinct"),
        *[F.count_if(F.col("block") == b).alias(f"n_{b}") for b in ("eval", "tune", "pool")],
    )
    return out.withColumn("n_questions", T.questions(spark, sf).agg(F.count(F.lit(1))).scalar())


@query(
    "blocks_restricted",
    f"""WITH {BLOCKS}, {CELLS}, asked AS (SELECT question_id FROM cells WHERE acc = 1)
    SELECT question_id, block FROM blocks SEMI JOIN asked USING (question_id)""",
)
def blocks_restricted(spark, sf):
    """The cut on the questions somebody always answers right."""
    asked = T.cells(spark, sf).filter(F.col("acc") == 1)
    return P.restrict_blocks(blocks(spark, sf), asked).select("question_id", "block")


@query(
    "blocks_holdout",
    f"""WITH {BLOCKS} SELECT question_id, bench, block FROM blocks
    WHERE NOT (block IN ('pool', 'tune') AND bench IN ('PROMO', 'SMALL'))""",
)
def blocks_holdout(spark, sf):
    return P.without_benchmarks(blocks(spark, sf), F.col("bench").isin("PROMO", "SMALL")).select(
        "question_id", "bench", "block"
    )


@query(
    "holdout_refit_jobs",
    f"""WITH {BLOCKS}, jobs AS (SELECT DISTINCT bench AS held_out FROM questions)
    SELECT held_out, count(*) FILTER (block = 'eval') AS n_eval, count(*) FILTER (block <> 'eval') AS n_fit,
      count(*) FILTER (block = 'eval' AND bench = held_out) AS n_scored
    FROM jobs, blocks WHERE NOT (block IN ('pool', 'tune') AND bench = held_out) GROUP BY 1""",
)
def holdout_refit_jobs(spark, sf):
    """Leave-one-benchmark-out refits: what each one may fit on and is scored on.

    Every count is a total minus the held-out benchmark's own count, so questions are not
    repeated once per job.
    """
    per = blocks(spark, sf).groupBy("bench").agg(
        F.count_if(F.col("block") == "eval").alias("e"), F.count_if(F.col("block") != "eval").alias("f")
    )
    tot = per.agg(F.sum("e").alias("e"), F.sum("f").alias("f"))
    return per.select(
        F.col("bench").alias("held_out"),
        tot.select("e").scalar().alias("n_eval"),
        (tot.select("f").scalar() - F.col("f")).alias("n_fit"),
        F.col("e").alias("n_scored"),
    )


@query(
    "half_splits",
    f"""WITH {QUESTIONS}, d AS (SELECT question_id, unnest(range(5))::INT AS draw FROM questions),
    p AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY {h("'7'", "'half'", 'draw', 'question_id')}, question_id) AS pos FROM d)
    SELECT draw, question_id, CASE WHEN pos <= (SELECT count(*) FROM questions) // 2 THEN 1 ELSE 2 END AS half FROM p""",
)
def half_splits(spark, sf):
    return P.half_splits(T.questions(spark, sf), 5, 7)


FOLDS = f"""folds AS (SELECT model_id, ((row_number() OVER (ORDER BY {h("'7'", "'fold'", 'model_id')}, model_id) - 1) % 5)::INT AS fold FROM models)"""


@query("model_folds", f"WITH {MODELS}, {FOLDS} SELECT model_id, fold FROM folds")
def model_folds(spark, sf):
    return P.k_folds(T.models(spark, sf), 5, 7)


@query(
    "run_splits",
    f"""WITH {MODELS}, seeds AS (SELECT model_id, family, unnest([0, 1, 2]) AS seed FROM models),
    p AS (SELECT *, ((row_number() OVER (PARTITION BY seed ORDER BY {h("seed", "'fold'", 'model_id')}, model_id) - 1) % 5)::INT AS fold FROM seeds),
    runs AS (SELECT seed, unnest(range(5))::INT AS run_fold, model_id, fold FROM p)
    SELECT seed, run_fold, CASE WHEN fold = run_fold THEN 'test' ELSE 'train' END AS side, count(*) AS n_models,
      min(model_id) AS first_model, max(model_id) AS last_model FROM runs GROUP BY ALL""",
)
def run_splits(spark, sf):
    """Every run of a folds x seeds protocol with its train and test side."""
    models = T.models(spark, sf).select("model_id")
    plans = None
    for seed in (0, 1, 2):
        plan = P.k_folds(models, 5, seed).withColumn("seed", F.lit(seed))
        plans = plan if plans is None else plans.unionByName(plan)
    # per (seed, fold) first: a run's train side is the total of the other folds
    return (
        plans.groupBy("seed", "fold")
        .agg(F.count(F.lit(1)).alias("n"), F.min("model_id").alias("lo"), F.max("model_id").alias("hi"))
        .withColumn("run_fold", draw_index(0, 4))
        .withColumn("side", F.when(F.col("fold") == F.col("run_fold"), "test").otherwise("train"))
        .groupBy("seed", "run_fold", "side")
        .agg(F.sum("n").alias("n_models"), F.min("lo").alias("first_model"), F.max("hi").alias("last_model"))
    )


@query("grouped_folds")
def grouped_folds(spark, sf):
    """Families kept whole, largest first into the least loaded fold (walk checked in the tests)."""
    return P.grouped_folds(T.models(spark, sf), "family", 3, 7)


@query(
    "fold_members",
    f"""WITH {MODELS}, {FOLDS}, plan AS (SELECT model_id, CASE WHEN model_id % 11 = 3 THEN -2 WHEN model_id % 7 = 1 THEN -1 ELSE fold END AS fold FROM folds)
    SELECT model_id, fold, CASE WHEN fold = 2 THEN 'test' WHEN fold <> -2 THEN 'train' END AS side FROM plan""",
)
def fold_members(spark, sf):
    """One fold's sides, with excluded (-2) and always-train (-1) codes in the plan."""
    m = F.col("model_id")
    plan = P.k_folds(T.models(spark, sf), 5, 7).withColumn(
        "fold", F.when(m % 11 == 3, P.EXCLUDED).when(m % 7 == 1, P.ALWAYS_TRAIN).otherwise(F.col("fold"))
    )
    return P.split(plan, 2)


PERM = f"""base AS (SELECT model_id, row_number() OVER (ORDER BY {h("'7'", "'base'", 'model_id')}, model_id) AS pos FROM models),
  pd AS (SELECT model_id AS source_id, unnest(range(1, {{n}} + 1))::INT AS draw FROM models),
  pp AS (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY {h("'7'", "'perm'", 'draw', 'source_id')}, source_id) AS pos FROM pd),
  perm AS (SELECT draw, model_id, source_id FROM pp JOIN base USING (pos))"""


@query("model_permutations", f"WITH {MODELS}, {PERM.format(n=20)} SELECT draw, model_id, source_id FROM perm")
def model_permutations(spark, sf):
    return P.permutations(T.models(spark, sf), 20, 7)


@query(
    "derangement",
    f"""WITH {MODELS}, {FOLDS}, s AS (SELECT model_id, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS side FROM folds),
    p AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY side) AS n, first_value(model_id) OVER w AS head,
          lead(model_id) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY side ORDER BY {h("'7'", "'derange'", 'model_id')}, model_id))
    SELECT model_id, side, CASE WHEN n > 1 THEN coalesce(nxt, head) END AS other FROM p""",
)
def derangement(spark, sf):
    """Shuffled control: every model reads another model of its own split side."""
    sides = P.split(P.k_folds(T.models(spark, sf), 5, 7), 0)
    return P.derangement(sides, "side", "model_id", 7)


@query(
    "gaussian_floor",
    f"""WITH {MODELS}, d AS (SELECT model_id, unnest(range(3))::INT AS draw FROM models), e AS (SELECT *, unnest(range(8))::INT AS dim FROM d)
    SELECT model_id, draw, dim, round({normal_sql("'7'", "'floor'", 'draw', 'model_id', 'dim')}, 6) AS value FROM e""",
)
def gaussian_floor(spark, sf):
    return rounded(P.gaussian_floor(T.models(spark, sf), 8, 3, 7), "value")


@query(
    "filled_grid",
    f"""WITH {COVER}, kept AS (SELECT model_id FROM cover WHERE coverage >= 0.9)
    SELECT k.model_id, q.question_id, q.bench, coalesce(c.correct, 0) AS correct, (c.correct IS NOT NULL)::INT AS covered
    FROM kept k CROSS JOIN questions q LEFT JOIN cells c ON c.model_id = k.model_id AND c.question_id = q.question_id""",
)
def filled_grid(spark, sf):
    """The built slice of the gated models: uncollected cells written as incorrect, with the mask."""
    return P.filled_grid(T.cells(spark, sf), G.coverage_gate(coverage(spark, sf), 0.9), T.questions(spark, sf))


# ---------------------------------------------------------------- selection
@query(
    "select_random",
    f"""WITH {QUESTIONS} SELECT question_id, 0.0::DOUBLE AS score FROM questions SEMI JOIN (SELECT DISTINCT p_brand || '|' || p_type AS question_id FROM lineitem JOIN part ON l_partkey = p_partkey) USING (question_id)
    ORDER BY {h("'7'", "'select'", 'question_id')} LIMIT 20""",
)
def select_random(spark, sf):
    return K.select(T.cells(spark, sf), "random", 20, 7)


@query(
    "select_discrimination",
    f"""WITH {LOO}, s AS (SELECT question_id, CASE WHEN count(*) >= 2 AND stddev_pop(acc) >= 1e-9 AND stddev_pop(theta) >= 1e-9 THEN corr(acc, theta) END AS score FROM loo GROUP BY 1)
    SELECT question_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC NULLS LAST, {h("'7'", "'select'", 'question_id')} LIMIT 20""",
)
def select_discrimination(spark, sf):
    scored = K.discrimination_scores(T.cells(spark, sf), 7).withColumn("score", F.round("score", 9))
    return rounded(K.top_k(scored, 20, 7), "score")


PRED = LOO + """, pred AS (SELECT model_id, question_id, bench, acc, correct, round(theta, 9) AS predicted FROM loo)"""


def predicted(spark, sf):
    """A prediction per cell to score: the model's mean over its other questions."""
    return C.loo_ability(T.cells(spark, sf)).withColumn("predicted", F.round("theta", 9)).drop("theta")


@query(
    "route_top1",
    f"""WITH {PRED}, r AS (SELECT question_id, model_id, predicted, row_number() OVER (PARTITION BY question_id ORDER BY predicted DESC, model_id) AS rn FROM pred)
    SELECT question_id, model_id, predicted FROM r WHERE rn = 1""",
)
def route_top1(spark, sf):
    return K.route(predicted(spark, sf))


# ---------------------------------------------------------------- rank statistics
MIDRANK = "rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0::DOUBLE"


@query(
    "mid_rank",
    f"WITH {CELLS} SELECT model_id, question_id, {MIDRANK.format(k='question_id', x='acc')} AS rank FROM cells",
)
def mid_rank(spark, sf):
    return R.mid_rank(T.cells(spark, sf), ["question_id"], "acc", "rank").select("model_id", "question_id", "rank")


AUC = """SELECT {k}, sum(y) AS n_pos, count(*) - sum(y) AS n_neg,
      CASE WHEN sum(y) > 0 AND count(*) > sum(y) THEN
        (sum(CASE WHEN y = 1 THEN rk ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (sum(y) * (count(*) - sum(y)))::DOUBLE END AS auroc
    FROM {src} GROUP BY {k}"""


@query(
    "column_auroc",
    f"""WITH {PRED}, r AS (SELECT *, (acc >= 0.5)::INT AS y, {MIDRANK.format(k='question_id', x='predicted')} AS rk FROM pred),
    a AS ({AUC.format(k='question_id', src='r')}) SELECT question_id, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auroc, 6) AS auroc FROM a""",
)
def column_auroc(spark, sf):
    return rounded(R.auroc(predicted(spark, sf), ["question_id"], "acc", "predicted"), "auroc")


@query(
    "row_auroc",
    f"""WITH {PRED}, d AS (SELECT question_id, round(avg(acc), 9) AS p FROM cells GROUP BY 1),
    x AS (SELECT pred.*, p FROM pred JOIN d USING (question_id)),
    r AS (SELECT *, (acc >= 0.5)::INT AS y, {MIDRANK.format(k='model_id', x='p')} AS rk FROM x),
    a AS ({AUC.format(k='model_id', src='r')}) SELECT model_id, n_pos::BIGINT AS n_pos, n_neg::BIGINT AS n_neg, round(auroc, 6) AS auroc FROM a""",
)
def row_auroc(spark, sf):
    """AUROC of each model's row against question difficulty."""
    cells = T.cells(spark, sf)
    p = cells.groupBy("question_id").agg(F.round(F.avg("acc"), 9).alias("p"))
    return rounded(R.auroc(cells.join(p, "question_id"), ["model_id"], "acc", "p"), "auroc")


@query(
    "spearman_by_benchmark",
    f"""WITH {CELLS}, s AS (SELECT model_id, bench, round(avg(acc), 9) AS a FROM cells GROUP BY ALL),
    t AS (SELECT model_id, bench, a, round((sum(a) OVER w - a) / (count(*) OVER w - 1), 9) AS rest FROM s WINDOW w AS (PARTITION BY model_id)),
    r AS (SELECT bench, {MIDRANK.format(k='bench', x='a')} AS ra, {MIDRANK.format(k='bench', x='rest')} AS rb FROM t)
    SELECT bench, round(CASE WHEN stddev_pop(ra) >= 1e-9 AND stddev_pop(rb) >= 1e-9 THEN corr(ra, rb) END, 6) AS spearman, count(*) AS n FROM r GROUP BY 1""",
)
def spearman_by_benchmark(spark, sf):
    """Rank agreement of a benchmark with the mean of the others."""
    return rounded(R.spearman(_bench_vs_rest(spark, sf), ["bench"], "a", "rest"), "spearman")


def _bench_vs_rest(spark, sf):
    s = T.cells(spark, sf).groupBy("model_id", "bench").agg(F.round(F.avg("acc"), 9).alias("a"))
    tot = s.groupBy("model_id").agg(F.sum("a").alias("sa"), F.count(F.lit(1)).alias("nb"))
    return s.join(tot, "model_id").select(
        "model_id", "bench", "a", F.round((F.col("sa") - F.col("a")) / (F.col("nb") - 1), 9).alias("rest")
    )


@query(
    "ndcg_at_10",
    f"""WITH {CELLS}, s AS (SELECT model_id, bench, round(avg(acc), 9) AS a FROM cells GROUP BY ALL),
    t AS (SELECT model_id, bench, a, round((sum(a) OVER w - a) / (count(*) OVER w - 1), 9) AS rest FROM s WINDOW w AS (PARTITION BY model_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY a DESC, model_id) AS ri, row_number() OVER (PARTITION BY bench ORDER BY rest DESC, model_id) AS rs FROM t)
    SELECT bench, round(CASE WHEN min(a) >= 0 AND sum(a / log2(ri + 1)) FILTER (ri <= 10) > 1e-9
      THEN (sum(a / log2(rs + 1)) FILTER (rs <= 10)) / (sum(a / log2(ri + 1)) FILTER (ri <= 10)) END, 6) AS ndcg FROM r GROUP BY 1""",
)
def ndcg_at_10(spark, sf):
    return rounded(R.ndcg(_bench_vs_rest(spark, sf), ["bench"], "a", "rest", "model_id", 10), "ndcg")


@query(
    "r2_pooled",
    f"""WITH {PRED}, p AS (SELECT question_id, sum((acc - predicted) ** 2) AS e, var_pop(acc) * count(*) AS t, count(*) AS n FROM pred GROUP BY 1)
    SELECT round(1 - sum(e) / sum(t), 6) AS r2, sum(n)::BIGINT AS n FROM p""",
)
def r2_pooled(spark, sf):
    return rounded(R.r2_pooled(predicted(spark, sf), [], ["question_id"], "acc", "predicted"), "r2")


@query(
    "macro_f1",
    f"""WITH {PRED}, x AS (SELECT bench, (correct)::INT AS truth, (predicted > 0.5 OR question_id LIKE 'Brand#1%')::INT AS guess FROM pred),
    cls AS (SELECT DISTINCT truth AS cls FROM x), k AS (SELECT DISTINCT bench FROM x),
    f AS (SELECT k.bench, c.cls, count(*) FILTER (truth = c.cls AND guess = c.cls) AS tp, count(*) FILTER (truth <> c.cls AND guess = c.cls) AS fp, count(*) FILTER (truth = c.cls AND guess <> c.cls) AS fn
      FROM x, cls c, k WHERE x.bench = k.bench GROUP BY ALL)
    SELECT bench, round(avg(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1 FROM f GROUP BY 1""",
)
def macro_f1(spark, sf):
    x = predicted(spark, sf).select(
        "bench",
        F.col("correct").alias("truth"),
        ((F.col("predicted") > 0.5) | F.col("question_id").startswith("Brand#1")).cast("int").alias("guess"),
    )
    classes = x.select(F.col("truth").alias("cls")).distinct()
    return rounded(R.macro_f1(x, ["bench"], "truth", "guess", classes), "macro_f1")


@query(
    "headroom",
    f"""WITH {CELLS}, s AS (SELECT bench, question_id, max(acc) AS oracle FROM cells GROUP BY ALL),
    b AS (SELECT bench, avg(oracle) AS best FROM s GROUP BY 1), m AS (SELECT bench, avg(acc) AS chance, quantile_cont(acc, 0.75) AS value FROM cells GROUP BY 1)
    SELECT bench, round(CASE WHEN abs(best - chance) > 1e-9 THEN (value - chance) / (best - chance) END, 6) AS headroom,
       round(CASE WHEN best - chance > 1e-9 THEN (value - chance) / (best - chance) END, 6) AS upward FROM b JOIN m USING (bench)""",
)
def headroom(spark, sf):
    """(value - chance) / (best - chance), and the form that needs a ceiling above chance."""
    from rosterlens.operators.scores import headroom as share

    cells = T.cells(spark, sf)
    best = cells.groupBy("bench", "question_id").agg(F.max("acc").alias("o")).groupBy("bench").agg(F.avg("o").alias("best"))
    # the exact quantile of a bounded set of values: fold equal accuracies first, weight by count
    val = cells.groupBy("bench", "acc").agg(F.count(F.lit(1)).alias("c")).groupBy("bench").agg(
        F.expr("percentile(acc, 0.75, c)").alias("value"), (F.sum(F.col("acc") * F.col("c")) / F.sum("c")).alias("chance")
    )
    out = best.join(val, "bench").select(
        "bench",
        share("value", "chance", "best").alias("headroom"),
        share("value", "chance", "best", upward=True).alias("upward"),
    )
    return rounded(out, "headroom", "upward")


@query(
    "model_class",
    f"""WITH {MODELS} SELECT model_id, name, CASE WHEN contains(lower(name), '0007') OR contains(lower(name), '#00000001') THEN '@reasoning' ELSE '@instruct' END AS model_class,
      CASE WHEN contains(lower(name), '0007') OR contains(lower(name), '#00000001') THEN 12288 ELSE 3072 END AS max_new_tokens,
      CASE WHEN contains(lower(name), '0007') OR contains(lower(name), '#00000001') THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS temperature FROM models""",
)
def model_class(spark, sf):
    """Reasoning test by name substring, and the generation budget that follows from it."""
    from rosterlens.operators.routing import generation_budget, model_class as cls

    markers = ("0007", "#00000001")
    return T.models(spark, sf).select(
        "model_id", "name", cls("name", markers).alias("model_class"), generation_budget("name", markers).alias("b")
    ).select("model_id", "name", "model_class", "b.max_new_tokens", "b.temperature")
