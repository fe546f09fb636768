"""Evaluation queries: heads and tasks on the fused embedding, scored on the held-out question block."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.functions import ranks as R
from rosterlens.functions import scalars as X
from rosterlens.operators import embed as E
from rosterlens.operators import heads as H
from rosterlens.operators import irt as I
from rosterlens.operators import portfolio as PF
from rosterlens.operators import selection as K
from rosterlens.operators import tasks as TK
from rosterlens.operators import traits as TR
from rosterlens.operators.labels import labels_long
from rosterlens.plans import run as RUN
from rosterlens.plans.common_sql import CELLS, MODELS
from rosterlens.plans.q_cells import rounded
from rosterlens.plans.q_labels import BOARDS, S_CARDS, aliases, boards, cards, measures, s_label
from rosterlens.plans.q_splits import PRED, blocks, predicted
from rosterlens.plans.q_vectors import ANSWERS, answers, fused, pooled, rounded_vec, train_models
from rosterlens.plans.registry import query
from rosterlens.session import cut_lineage
from rosterlens.sources import tables as T

#: Which published board plays which label task.
BOARD_OF = {"flag_A": "chatbot_arena_elo", "flag_N": "ext_arena_rating", "flag_R": "lb_pt_average"}

_RUNS: dict[tuple[str, str], TK.Bench] = {}


def supplier_cards(spark, sf):
    """Every customer card belongs to a supplier, and all of a supplier's cards count."""
    n = T.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    card = cards(spark, sf).select((F.col("card_id") % n).alias("model_id"), "c").select(
        "model_id",
        F.col("c.popularity.downloads").cast("double").alias("downloads"),
        X.log2(F.col("c.architecture.max_position_embeddings").cast("double")).alias("context"),
        X.days_since_epoch(F.col("c.timestamps.createdAt")).alias("created"),
        X.architecture_family(F.col("c.architecture.model_type")).alias("architecture"),
        X.license_type(F.col("c.metadata.license")).alias("license"),
    )
    return card.groupBy("model_id").agg(
        X.log10_1p(F.sum(F.when(F.col("downloads") >= 0, F.col("downloads")))).alias("hf_downloads"),
        F.max("context").alias("hf_context_length"),
        F.min("created").alias("hf_release_date"),
        F.mode(F.nullif("architecture", F.lit("unknown")), deterministic=True).alias("hf_architecture_family"),
        F.mode(F.nullif("license", F.lit("unknown")), deterministic=True).alias("hf_license_type"),
    )


def answer_traits(spark, sf):
    """The traits of the texts of a model's draws, by question."""
    said = T.responses(spark, sf).select("model_id", F.col("part_id").cast("string").alias("question_id"), F.col("prediction").alias("text"))
    return TR.text_traits(said)


def bench(spark, sf) -> TK.Bench:
    """The scoring run on these tables: fitted on the pool and tune blocks, scored on eval.

    Its parts are written once per application, those that only some tasks read when the first of them runs.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        every = cut_lineage(T.cells(spark, sf))
        cells = every.join(blocks(spark, sf).filter("block = 'eval'"), "question_id", "left_semi")
        name = F.lit(None).cast("string")
        for board, task in BOARD_OF.items():
            name = F.when(F.col("board") == board, task).otherwise(name)
        _RUNS[key] = TK.Bench(
            embedding=cut_lineage(fused(spark, sf, ("pool", "tune"), every)),
            cells=cut_lineage(cells),
            models=cut_lineage(T.models(spark, sf)),
            labels=lambda: labels_long(T.models(spark, sf), boards(spark, sf), aliases(spark, sf)).withColumn("board", name),
            cache={
                "cards": lambda: supplier_cards(spark, sf),
                "traits": lambda: answer_traits(spark, sf),
                "answers": answers(spark, sf, every, by="model_id"),  # read where it is needed, not written: it is as wide as a vector for each cell
                "measures": lambda: measures(spark, sf),
            },
        )
    return _RUNS[key]


def metrics(df):
    """Doubles of a metric row, rounded."""
    return rounded(df, *[n for n, t in df.dtypes if t == "double"])


# ---------------------------------------------------------------- heads
@query("oof_ridge")
def oof_ridge(spark, sf):
    """Out-of-fold ridge of mean accuracy and size on the embedding."""
    b = bench(spark, sf)
    y = b.accuracy().join(b.models.select("model_id", F.coalesce("params_b", F.lit(0.0)).alias("s")), "model_id")
    out = H.oof_ridge(TK.rows_for(b, y.select("model_id", F.array("y", "s").alias("y"))))
    return rounded_vec(out.select("model_id", "fold", "predicted"), "predicted", 5)


@query("oof_logistic")
def oof_logistic(spark, sf):
    b = bench(spark, sf)
    out = TK.classify(b, b.models.select("model_id", F.col("is_chat").alias("label")))
    return rounded(out, "score", digits=4)


@query("fit_2pl_items")
def fit_2pl_items(spark, sf):
    """Item parameters of the two-parameter response model."""
    return rounded(I.fit_2pl(T.cells(spark, sf)).items, "a", "b", digits=4)


@query("fit_2pl_objective")
def fit_2pl_objective(spark, sf):
    c = cut_lineage(T.cells(spark, sf))
    return rounded(I.objective(c, I.fit_2pl(c)), "loss")


@query("ability_fold_in")
def ability_fold_in(spark, sf):
    """Held-out models placed on items fitted without them."""
    c = cut_lineage(T.cells(spark, sf))
    tr = train_models(spark, sf)
    fit = I.fit_2pl(c.join(tr, "model_id", "left_semi"))
    return rounded(I.fold_in_ability(c.join(tr, "model_id", "left_anti"), fit.items), "theta", digits=4)


@query("select_fisher")
def select_fisher(spark, sf):
    """The interview: the 20 questions with the highest test information."""
    return rounded(K.select(T.cells(spark, sf), "fisher", 20, 7), "score", digits=4)


# ---------------------------------------------------------------- tasks
def _register(name: str) -> None:
    def run(spark, sf):
        return metrics(TK.TASKS[name].run(bench(spark, sf)))

    run.__doc__ = TK.TASKS[name].run.__doc__
    query(f"task_{name}")(run)


for _name in (
    "score_regression",
    "model_size_regression",
    "reasoning_style",
    "ranking",
    "cross_benchmark",
    "error_type",
    "family_classification",
    "base_vs_chat",
    "stage5a_routing",
    "item_information",
    "external_topk",
    "pairwise",
    "answer_divergence",
    "model_authorship",
    "rm_style",
    "rm_mean",
    "length_profile",
    "hedge_style",
    "refusal_rate",
    "specialisation",
    "knapsack",
    "hf_downloads",
    "hf_context_length",
    "hf_release_date",
    "hf_architecture_family",
    "hf_license_type",
):
    _register(_name)


_SPECS = ", ".join(f"('{t.name}', '{t.group}', '{t.source}', '{t.label}', '{t.folds}', {t.floor})" for t in TK.TASKS.values())
_BOARD = f"CASE board {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in BOARD_OF.items())} END"


@query(
    "task_skips",
    f"""WITH {MODELS}, {BOARDS}, {S_CARDS}, {s_label('flag_A', 'la')}, {s_label('flag_N', 'ln')}, {s_label('flag_R', 'lr')},
    specs(task, grp, source, label, folds, floor) AS (VALUES {_SPECS}),
    u AS (SELECT 'flag_A' AS board, value FROM la UNION ALL SELECT 'flag_N', value FROM ln UNION ALL SELECT 'flag_R', value FROM lr),
    seen AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem),
    card AS (SELECT card_id % (SELECT count(*) FROM supplier) AS model_id, downloads, lic FROM cards),
    counts AS (SELECT 'boards' AS source, {_BOARD} AS label, count(value) AS n FROM u GROUP BY 2
      UNION ALL SELECT 'measures', 'rm', n FROM seen UNION ALL SELECT '', '', n FROM seen
      UNION ALL SELECT 'traits', unnest(['log_n_tok', 'hedge_rate', 'refusal_rate']), n FROM seen
      UNION ALL SELECT 'cards', 'hf_downloads', count(DISTINCT model_id) FROM card JOIN models USING (model_id) WHERE downloads >= 0
      UNION ALL SELECT 'cards', 'hf_license_type', count(DISTINCT model_id) FROM card JOIN models USING (model_id) WHERE lic <> ''
      UNION ALL SELECT 'cards', c, n FROM (SELECT count(DISTINCT model_id) AS n FROM card JOIN models USING (model_id)), (SELECT unnest(['hf_context_length', 'hf_release_date', 'hf_architecture_family']) AS c)),
    j AS (SELECT s.*, coalesce(n, 0)::BIGINT AS n_labelled FROM specs s LEFT JOIN counts c ON c.source = s.source AND c.label = s.label)
    SELECT *, n_labelled >= floor AS runnable, CASE WHEN n_labelled < floor THEN n_labelled || ' labelled models, ' || floor || ' needed' END AS reason FROM j""",
)
def task_skips(spark, sf):
    """Every task with how many models its label covers, and why it can't run where it can't."""
    return TK.task_table(bench(spark, sf))


@query("task_boards")
def task_boards(spark, sf):
    """Every label-driven task; those without labels on this run say so in a note."""
    b = bench(spark, sf)
    out = TK.run_tasks(b, list(TK.BOARD_TASKS))
    return rounded(out, "value")


@query(
    "route_and_price",
    f"""WITH {PRED}, r AS (SELECT question_id, model_id, acc, row_number() OVER (PARTITION BY question_id ORDER BY predicted DESC, model_id) AS rn FROM pred),
    nq AS (SELECT count(DISTINCT question_id) AS n FROM cells), a AS (SELECT sum(acc) / (SELECT n FROM nq) AS ra FROM r WHERE rn = 1),
    o AS (SELECT sum(m) / (SELECT n FROM nq) AS ro FROM (SELECT max(acc) AS m FROM cells GROUP BY question_id)), s AS (SELECT max(t) / (SELECT n FROM nq) AS rs FROM (SELECT sum(acc) AS t FROM cells GROUP BY model_id))
    SELECT round(ra, 6) AS routing_acc, round(ro, 6) AS routing_oracle, round(rs, 6) AS routing_best_single, (SELECT n FROM nq) AS n_routing_questions,
      round(ro - rs, 6) AS oracle_headroom, round(CASE WHEN ro - rs > 1e-9 THEN (ra - rs) / (ro - rs) END, 6) AS gap_closed FROM a, o, s""",
)
def route_and_price(spark, sf):
    """Top-1 routing by leave-one-out ability, priced between best single model and oracle."""
    p = predicted(spark, sf)
    return metrics(TK.price_routing(T.cells(spark, sf), K.route(p)))


@query(
    "reasoning_tilt",
    f"""WITH {CELLS}, s AS (SELECT model_id, bench, avg(acc) AS a FROM cells GROUP BY ALL)
    SELECT model_id, round(avg(a) FILTER (bench IN ('ECONOMY', 'LARGE')) - avg(a) FILTER (bench NOT IN ('ECONOMY', 'LARGE')), 6) AS y FROM s GROUP BY 1""",
)
def reasoning_tilt(spark, sf):
    """Composite of one benchmark family minus the rest."""
    b = TK.Bench(embedding=T.models(spark, sf), cells=T.cells(spark, sf), models=T.models(spark, sf))
    s = b.cells.groupBy("model_id", "bench").agg(F.avg("acc").alias("score"))
    b.cache["bench"] = s
    return rounded(TK.tilt(b, F.col("bench").isin("ECONOMY", "LARGE")), "y")




@query(
    "mean_divergence",
    f"""WITH {CELLS}, {ANSWERS}, u AS (SELECT model_id, question_id, list_transform(emb, lambda x: x / sqrt(list_dot_product(emb, emb))) AS e FROM answers)
    SELECT a.model_id, round(1 - sum(list_dot_product(a.e, b.e)) / count(*), 6) AS y, count(*) AS n FROM u a JOIN u b ON a.question_id = b.question_id AND a.model_id <> b.model_id GROUP BY 1""",
)
def mean_divergence(spark, sf):
    """A model's mean answer distance to all others, over the questions both answered."""
    return rounded(TK.mean_divergence(answers(spark, sf)), "y")


@query(
    "pair_concordance",
    f"""WITH {PRED}, s AS (SELECT model_id, bench, round(avg(acc), 2) AS t, round(avg(predicted), 2) AS p FROM pred GROUP BY ALL)
    SELECT a.bench, count(*) FILTER (a.p > b.p) AS concordant, count(*) FILTER (a.p = b.p) AS tied, count(*) AS pairs,
      round((count(*) FILTER (a.p > b.p) + 0.5::DOUBLE * count(*) FILTER (a.p = b.p)) / count(*), 6) AS accuracy
    FROM s a JOIN s b ON a.bench = b.bench AND a.t > b.t GROUP BY 1""",
)
def pair_concordance(spark, sf):
    """Per benchmark: the share of model pairs a prediction orders right, counted without listing pairs."""
    s = predicted(spark, sf).groupBy("model_id", "bench").agg(F.round(F.avg("acc"), 2).alias("t"), F.round(F.avg("predicted"), 2).alias("p"))
    return rounded(R.concordance(s, ["bench"], "t", "p"), "accuracy")


def costs(spark, sf):
    return T.models(spark, sf).filter("vram_gb IS NOT NULL").select("model_id", F.col("vram_gb").alias("gb"))


@query("greedy_portfolio")
def greedy_portfolio(spark, sf):
    """The squad a greedy max-coverage walk picks under 24, 48, 80 and 160 GB, and its oracle-routed accuracy."""
    cost = cut_lineage(costs(spark, sf))
    rows = cut_lineage(T.cells(spark, sf).join(cost, "model_id", "left_semi").select(F.lit(0).alias("bank"), "model_id", "question_id", F.col("acc").alias("a")))
    n = rows.agg(F.countDistinct("question_id")).scalar()
    walks = spark.createDataFrame([(i, 0, g) for i, g in enumerate(PF.BUDGETS)], "walk int, bank int, budget double")
    picks = PF.greedy(rows, cost, walks).join(walks, "walk")
    value = PF.squad_rows(rows, picks).groupBy("walk").agg(F.sum("best").alias("s"))
    out = picks.join(value, "walk").select("model_id", "gb", F.col("budget").alias("budget_gb"), (F.col("s") / n).alias("value"))
    return rounded(out, "value", "gb")


@query("random_squads")
def random_squads(spark, sf):
    """Twenty random affordable squads of at most four models."""
    return rounded(PF.random_squads(costs(spark, sf), 48.0, 4, 20, 7), "gb")


@query("latent_factors")
def latent_factors(spark, sf):
    """Latent factors of the correctness table."""
    return rounded_vec(E.latent_factors(T.cells(spark, sf), 4, 7), "vec", 3)


@query("evaluate_arms")
def evaluate_arms(spark, sf):
    """Three arms fitted on the pool and tune blocks, scored on eval, each against the random floor of its width."""
    b = bench(spark, sf)
    cells = T.cells(spark, sf)
    fit = cut_lineage(cells.join(blocks(spark, sf).filter("block <> 'eval'"), "question_id", "left_semi"))
    RUN.check_no_leak(fit, b.cells)
    fitted = RUN.fit_arms(fit, pooled(spark, sf), train_models(spark, sf), b.models, 8, 7)
    names = RUN.select_tasks(["score_regression", "cross_benchmark", "stage5a_routing"])
    out = RUN.score_arms(b, fitted, names, 8).select("method", "task", "s", "floor_arm", "floor_s", "s_over_floor")
    return metrics(out)
