"""Queries on score tables. A result is the mean grade of the draws of one (arm, task, seed)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.operators import intervals as IV
from rosterlens.operators import scores as S
from rosterlens.plans.common_sql import CELLS, h
from rosterlens.plans.q_cells import near, rounded
from rosterlens.plans.q_splits import MIDRANK
from rosterlens.plans.registry import query
from rosterlens.session import staged
from rosterlens.sources import tables as T

#: Return flag + line status -> arm.
ARMS = {"AF": "arm32", "AO": "arm48", "NF": "arm768", "NO": "null_random16", "RF": "null_random32", "RO": "null_random768"}
DIMS = {"arm32": 32, "arm48": 48, "arm768": 768, "null_random16": 16, "null_random32": 32, "null_random768": 768}
BASE = "null_random16"
#: An unclipped score beyond this magnitude is flagged; low, so that the flag fires here.
FACTOR = 0.2


def _case(col, table, default=None):
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def result_draws(spark, sf):
    """lineitem as scored draws: method, task = brand, seed = line number mod 3, holdout = part type."""
    line = T.table(spark, sf, "lineitem").select(
        _case(F.concat("l_returnflag", "l_linestatus"), ARMS).alias("method"), (F.col("l_linenumber") % 3).alias("seed"),
        F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("line_no"), (F.col("l_quantity") > 25).cast("int").alias("c"),
    )
    part = T.table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("task"), F.col("p_type").alias("bench"))
    return line.join(part, "p_partkey")


def number(task="task"):
    return F.replace(task, F.lit("Brand#"), F.lit("")).cast("int")


def shape(df):
    """Group, orientation and kind of a task, from its number; one arm misses one task."""
    k = number()
    return df.withColumns(
        {
            "grp": F.concat(F.lit("g"), (k % 3).cast("string")),
            "lower_is_better": k % 7 == 0,
            "diagnostic": k % 11 == 0,
            "value": F.when(~((F.col("method") == "arm768") & (k == 4)), F.col("value")),
        }
    )


def results(spark, sf):
    return shape(result_draws(spark, sf).groupBy("method", "task", "seed").agg(F.avg("c").alias("value")))


RES = f"""rd AS (SELECT CASE l_returnflag || l_linestatus {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in ARMS.items())} END AS method, l_linenumber % 3 AS seed, l_linenumber AS line_no,
    p_brand AS task, p_type AS bench, (l_quantity > 25)::INT AS c, replace(p_brand, 'Brand#', '')::INT AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
  results AS (SELECT method, task, seed, 'g' || (k % 3) AS grp, k % 7 = 0 AS lower_is_better, k % 11 = 0 AS diagnostic,
    CASE WHEN NOT (method = 'arm768' AND k = 4) THEN avg(c) END AS value FROM rd GROUP BY method, task, seed, k)"""


def per_task(spark, sf):
    return result_draws(spark, sf).filter("line_no = 7").groupBy("task").agg(F.avg("c").alias("chance"))


def per_arm(spark, sf):
    d = result_draws(spark, sf).filter((F.col("line_no") == 6) & (F.col("method") == "arm32") & (number() % 2 == 0))
    return d.groupBy("method", "task").agg(F.avg("c").alias("chance"))


def weights(spark, sf):
    k = number()
    tasks = T.table(spark, sf, "part").select(F.col("p_brand").alias("task")).distinct()
    return S.cluster_weights(tasks.filter(k <= 6).withColumn("cluster", F.when(k <= 4, "a").otherwise("b")))


SEEDS = f"""{RES}, pt AS (SELECT task, avg(c) AS chance FROM rd WHERE line_no = 7 GROUP BY 1), pa AS (SELECT method, task, avg(c) AS chance FROM rd WHERE line_no = 6 AND method = 'arm32' AND k % 2 = 0 GROUP BY 1, 2),
  sc AS (SELECT r.*, coalesce(pa.chance, pt.chance) AS chance FROM results r LEFT JOIN pa USING (method, task) LEFT JOIN pt USING (task)),
  su AS (SELECT *, CASE WHEN (CASE WHEN lower_is_better THEN chance ELSE 1 - chance END) > 1e-12 THEN (value - chance) / (CASE WHEN lower_is_better THEN 0 ELSE 1 END - chance) END AS unclipped FROM sc),
  ss AS (SELECT *, greatest(-1, least(1, unclipped)) AS s FROM (SELECT * FROM su WHERE unclipped IS NOT NULL) UNION ALL SELECT *, NULL FROM su WHERE unclipped IS NULL),
  seeds AS (SELECT ss.*, s - b.base AS delta, (abs(unclipped) > {FACTOR})::INT AS diverged FROM ss LEFT JOIN (SELECT task, seed, avg(s) AS base FROM ss WHERE method = '{BASE}' GROUP BY 1, 2) b USING (task, seed))"""
FRAME = f"""{SEEDS}, wt AS (SELECT DISTINCT task, CASE WHEN k <= 4 THEN 0.25::DOUBLE ELSE 0.5 END AS w FROM rd WHERE k <= 6),
  f0 AS (SELECT method, task, grp, diagnostic, avg(s) AS s, avg(unclipped) AS unclipped, arg_max(unclipped, (abs(unclipped), -seed)) AS worst_seed, count(s) AS n_seeds FROM seeds GROUP BY 1, 2, 3, 4),
  frame AS (SELECT f0.*, coalesce(w, 1.0::DOUBLE) AS w, s - b.base AS delta, (s > 0)::INT AS above_chance FROM f0 LEFT JOIN wt USING (task) LEFT JOIN (SELECT task, avg(s) AS base FROM f0 WHERE method = '{BASE}' GROUP BY 1) b USING (task))"""


def seeds(spark, sf):
    return S.score_seeds(results(spark, sf), per_arm(spark, sf), per_task(spark, sf), BASE, FACTOR)


def frame(spark, sf):
    return S.score_frame(seeds(spark, sf), weights(spark, sf), BASE)


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def boot_slots(src: str, keys: str, unit: str, draws: int, purpose: str) -> str:
    """Resample counts in SQL: b_times(keys, draw, unit, times)."""
    kk = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    on = "USING (" + (f"{keys}, " if keys else "") + "pos)"
    return f"""bu AS (SELECT DISTINCT {kk}{unit} FROM {src}), bp AS (SELECT *, row_number() OVER ({part}ORDER BY {h("'7'", f"'{purpose}'", *( [k.strip() for k in keys.split(',')] if keys else []), unit)}, {unit}) AS pos, {f'count(*) OVER (PARTITION BY {keys})' if keys else 'count(*) OVER ()'} AS n FROM bu),
  bd AS (SELECT *, unnest(range(1, {draws} + 1))::INT AS draw FROM bp), bk AS (SELECT {kk}draw, {h("'7'", f"'{purpose}-slot'", *([k.strip() for k in keys.split(',')] if keys else []), 'draw', 'pos')} % n + 1 AS pos FROM bd),
  b_times AS (SELECT {kk}draw, {unit}, count(*) AS times FROM bk JOIN bp {on} GROUP BY ALL)"""


# ------------------------------------------------ pooling
@query(
    "pool_seeds",
    f"""WITH {RES}, ok AS (SELECT * FROM results WHERE value IS NOT NULL), {boot_slots('ok', 'method, task', 'seed', 200, 'boot')},
    st AS (SELECT method, task, draw, sum(value * times) / sum(times) AS stat FROM b_times JOIN ok USING (method, task, seed) GROUP BY ALL),
    ci AS (SELECT method, task, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM st GROUP BY ALL),
    b AS (SELECT method, task, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n, count(*) - count(value) AS n_missing FROM results GROUP BY ALL)
    SELECT method, task, round(mean, 6) AS mean, CASE WHEN n > 1 THEN round(sd, 6) END AS sd, CASE WHEN n > 1 THEN round(lo, 6) END AS lo, CASE WHEN n > 1 THEN round(hi, 6) END AS hi, n, n_missing FROM b LEFT JOIN ci USING (method, task)""",
)
def pool_seeds(spark, sf):
    """Mean, spread and bootstrap interval over seeds."""
    return rounded(S.pool_seeds(results(spark, sf), 200, 7), "mean", "sd", "lo", "hi")


@query(
    "bootstrap_mean",
    f"""WITH {CELLS}, ok AS (SELECT bench, model_id, avg(acc) AS v FROM cells GROUP BY ALL), {boot_slots('ok', 'bench', 'model_id', 100, 'boot')},
    st AS (SELECT bench, draw, sum(v * times) / sum(times) AS stat FROM b_times JOIN ok USING (bench, model_id) GROUP BY ALL)
    SELECT bench, round(m, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM (SELECT bench, avg(v) AS m, count(v) AS n FROM ok GROUP BY 1)
      JOIN (SELECT bench, quantile_cont(stat, 0.025) AS lo, quantile_cont(stat, 0.975) AS hi FROM st GROUP BY 1) USING (bench)""",
)
def bootstrap_mean(spark, sf):
    """Mean score per benchmark with a percentile interval over models."""
    s = T.cells(spark, sf).groupBy("bench", "model_id").agg(F.avg("acc").alias("v"))
    return rounded(S.bootstrap_mean(s, ["bench"], "model_id", "v", 100, 7), "mean", "lo", "hi")


@query(
    "cluster_interval",
    f"""WITH {CELLS}, sums AS (SELECT bench, sum(acc) AS s, count(acc) AS c FROM cells GROUP BY 1), {boot_slots('sums', '', 'bench', 200, 'cluster')},
    st AS (SELECT draw, sum(times * s) / sum(times * c) AS stat FROM b_times JOIN sums USING (bench) GROUP BY 1), p AS (SELECT sum(s) / sum(c) AS point, count(*) AS n_units FROM sums)
    SELECT round(any_value(point), 6) AS point, round(least(quantile_cont(stat, 0.025), any_value(point)), 6) AS ci_lo, round(greatest(quantile_cont(stat, 0.975), any_value(point)), 6) AS ci_hi, any_value(n_units) AS n_units FROM st, p""",
)
def cluster_interval(spark, sf):
    """Interval of the mean cell accuracy when whole benchmarks are redrawn."""
    return rounded(S.cluster_interval(T.cells(spark, sf), "bench", "acc", 200, 7), "point", "ci_lo", "ci_hi")


# ------------------------------------------------ anchoring
@query("score_seeds", f"WITH {SEEDS} SELECT method, task, seed, {r6('chance', 'unclipped', 's', 'delta')}, diverged FROM seeds")
def score_seeds(spark, sf):
    """Every seed's metric anchored between its chance level and the best value."""
    out = seeds(spark, sf).select("method", "task", "seed", "chance", "unclipped", "s", "delta", "diverged")
    return rounded(out, "chance", "unclipped", "s", "delta")


@query("score_frame", f"WITH {FRAME} SELECT method, task, grp, n_seeds, above_chance, {r6('s', 'unclipped', 'worst_seed', 'w', 'delta')} FROM frame")
def score_frame(spark, sf):
    out = frame(spark, sf).select("method", "task", "grp", "n_seeds", "above_chance", "s", "unclipped", "worst_seed", "w", "delta")
    return rounded(out, "s", "unclipped", "worst_seed", "w", "delta")


@query("diverged_cells", f"WITH {SEEDS} SELECT method, task, seed, {r6('unclipped')} FROM seeds WHERE diverged = 1 ORDER BY abs(unclipped) DESC")
def diverged_cells(spark, sf):
    """Flagged seeds, worst magnitude first."""
    out = seeds(spark, sf).filter("diverged = 1").orderBy(F.abs("unclipped").desc())
    return rounded(out.select("method", "task", "seed", "unclipped"), "unclipped")


@query(
    "group_scores",
    f"""WITH {FRAME}, d AS (SELECT * FROM frame WHERE NOT diagnostic), kept AS (SELECT * FROM d WHERE s IS NOT NULL),
    common AS (SELECT grp, task FROM kept JOIN (SELECT grp, count(DISTINCT method) AS arms FROM kept GROUP BY 1) USING (grp) GROUP BY grp, task, arms HAVING count(DISTINCT method) = arms),
    x AS (SELECT d.*, c.task IS NOT NULL AS shared FROM d LEFT JOIN common c USING (grp, task))
    SELECT method, grp, round(sum(w * s) / sum(w) FILTER (s IS NOT NULL), 6) AS score, count(s) AS n_tasks, round(sum(w) FILTER (s IS NOT NULL), 6) AS eff_tasks,
      round((sum(w * s) FILTER (shared)) / (sum(w) FILTER (shared AND s IS NOT NULL)), 6) AS score_common, count(s) FILTER (shared) AS n_tasks_common,
      count(*) FILTER (above_chance = 1) AS n_above, coalesce(bool_or(above_chance = 1), false)::INT AS any_above, count(*) - count(s) AS n_dropped,
      coalesce(string_agg(task, '|' ORDER BY task) FILTER (s IS NOT NULL), '') AS tasks_scored, coalesce(string_agg(task, '|' ORDER BY task) FILTER (s IS NULL), '') AS tasks_dropped
    FROM x GROUP BY 1, 2 HAVING count(s) > 0""",
)
def group_scores(spark, sf):
    return rounded(S.group_scores(frame(spark, sf)), "score", "eff_tasks", "score_common")


@query(
    "task_cohorts",
    f"""WITH {FRAME}, st AS (SELECT method, string_agg(task, '|' ORDER BY task) AS tasks FROM frame WHERE NOT diagnostic AND s IS NOT NULL GROUP BY 1)
    SELECT tasks, string_agg(method, '|' ORDER BY method) AS methods, count(*) AS n_methods FROM st GROUP BY 1""",
)
def task_cohorts(spark, sf):
    return S.cohorts(frame(spark, sf))


PANEL = """kd AS (SELECT * FROM frame WHERE NOT diagnostic AND s IS NOT NULL), panel AS (SELECT task, method, s, w FROM kd WHERE task IN (SELECT task FROM kd GROUP BY 1 HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM kd)))"""
BOOT = f"""{PANEL}, {boot_slots('panel', '', 'task', 300, 'paired')},
  st AS (SELECT draw, method, round(sum(times * w * s) / sum(times * w), 12) AS stat FROM panel JOIN b_times USING (task) GROUP BY ALL),
  ld AS (SELECT *, stat = max(stat) OVER (PARTITION BY draw) AS lead FROM st), lw AS (SELECT *, CASE WHEN lead THEN 1.0::DOUBLE / count(*) FILTER (lead) OVER (PARTITION BY draw) ELSE 0 END AS won FROM ld),
  boot AS (SELECT method, score, n_tasks, quantile_cont(stat, 0.025) AS lcb, quantile_cont(stat, 0.975) AS ucb, avg(won) AS p_top1
    FROM lw JOIN (SELECT method, sum(w * s) / sum(w) AS score, count(*) AS n_tasks FROM panel GROUP BY 1) USING (method) GROUP BY ALL)"""


@query("paired_bootstrap", f"WITH {FRAME}, {BOOT} SELECT method, n_tasks, {r6('score', 'lcb', 'ucb', 'p_top1')} FROM boot")
def paired_bootstrap(spark, sf):
    return rounded(S.paired_bootstrap(frame(spark, sf), 300, 7), "score", "lcb", "ucb", "p_top1")


@query("maximal_set", f"WITH {FRAME}, {BOOT} SELECT method FROM boot WHERE ucb >= (SELECT max(lcb) FROM boot)")
def maximal_set(spark, sf):
    return S.maximal_set(S.paired_bootstrap(frame(spark, sf), 300, 7)).select("method")


@query(
    "competence_residual_null",
    f"WITH {FRAME} SELECT method, task, grp, round(w, 6) AS w, round(delta, 6) AS s, (delta > 0)::INT AS above_chance FROM frame WHERE NOT diagnostic AND s IS NOT NULL",
)
def competence_residual_null(spark, sf):
    return rounded(S.residual_against_null(frame(spark, sf)), "w", "s")


@query(
    "competence_residual_fit",
    f"""WITH {FRAME}, d AS (SELECT * FROM frame WHERE NOT diagnostic AND s IS NOT NULL), cp AS (SELECT method, s AS x FROM d WHERE task = 'Brand#1'), j AS (SELECT d.*, x FROM d LEFT JOIN cp USING (method) WHERE task <> 'Brand#1'),
    ln AS (SELECT task, regr_slope(s, x) AS b, regr_intercept(s, x) AS a FROM j WHERE x > -1 + 1e-3 GROUP BY 1 HAVING count(x) >= 4 AND stddev_samp(x) >= 1e-12)
    SELECT method, task, grp, round(w, 6) AS w, round(s - (a + b * x), 6) AS s, (s - (a + b * x) > 0)::INT AS above_chance FROM j JOIN ln USING (task)""",
)
def competence_residual_fit(spark, sf):
    return rounded(S.residual_against_fit(frame(spark, sf), "Brand#1"), "w", "s")


# ------------------------------------------------ runs and floors
def holdout(spark, sf):
    """Main rows and rows of held-out benchmarks, as (run, method, task, grp, s, dim): a run is a seed."""
    d = result_draws(spark, sf).withColumnRenamed("seed", "run")
    main = d.groupBy("run", "method", "task").agg(F.avg("c").alias("s")).withColumn("grp", F.lit(""))
    held = d.filter(F.col("bench").isin("PROMO", "SMALL")).groupBy("run", "method", "task", F.col("bench").alias("grp")).agg(F.avg("c").alias("s"))
    dim = _case(F.col("method"), DIMS)
    return main.withColumn("dim", dim), held.withColumn("dim", dim)


HOLD = f"""{RES}, dm(method, dim) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in DIMS.items())}),
  mn AS (SELECT seed AS run, method, task, '' AS grp, avg(c) AS s FROM rd GROUP BY ALL), hd AS (SELECT seed AS run, method, task, bench AS grp, avg(c) AS s FROM rd WHERE bench IN ('PROMO', 'SMALL') GROUP BY ALL)"""


@query(
    "holdout_rows",
    f"""WITH {HOLD}, m0 AS (SELECT method, task, avg(s) AS s FROM mn GROUP BY ALL), h0 AS (SELECT method, task, grp, avg(s) AS s FROM hd GROUP BY ALL)
    SELECT method, task, grp, round(s, 6) AS s, dim, round(lo, 6) AS ci_lo, round(hi, 6) AS ci_hi, n_units FROM (
      SELECT method, task, '' AS grp, s, NULL::DOUBLE AS lo, NULL::DOUBLE AS hi, NULL::BIGINT AS n_units FROM m0 UNION ALL SELECT method, task, grp, s, NULL, NULL, NULL FROM h0
      UNION ALL SELECT method, task, 'mean', avg(s), min(s), max(s), count(DISTINCT grp) FROM h0 GROUP BY method, task) JOIN dm USING (method)""",
)
def holdout_rows(spark, sf):
    """Main, held-out and mean-over-groups rows in one table."""
    main, held = holdout(spark, sf)
    m = main.groupBy("method", "task", "grp").agg(F.avg("s").alias("s"), F.max("dim").alias("dim"))
    hh = held.groupBy("method", "task", "grp").agg(F.avg("s").alias("s"), F.max("dim").alias("dim"))
    out = S.holdout_rows(m, hh).select("method", "task", "grp", "s", "dim", "ci_lo", "ci_hi", "n_units")
    return rounded(out, "s", "ci_lo", "ci_hi")


FLOORED = """fl AS (SELECT method, task, grp, avg(s) AS floor_s, count(s) AS floor_draws, stddev_samp(s) AS floor_sd FROM (SELECT * FROM mn UNION ALL SELECT * FROM hd) WHERE method IN ('null_random16', 'null_random32') GROUP BY ALL),
  al AS (SELECT a.*, dim FROM (SELECT * FROM mn UNION ALL SELECT * FROM hd) a JOIN dm USING (method)),
  nr AS (SELECT *, 'null_random' || CASE WHEN dim <= 24 THEN 16 WHEN dim <= 400 THEN 32 ELSE 768 END AS floor_arm FROM al),
  fd AS (SELECT nr.*, coalesce(fl.floor_s, sg.s) AS fs, CASE WHEN fl.floor_s IS NOT NULL THEN fl.floor_draws WHEN sg.s IS NOT NULL THEN 1 END AS fd, fl.floor_sd AS fsd
    FROM nr LEFT JOIN fl ON fl.method = nr.floor_arm AND fl.task = nr.task AND fl.grp = nr.grp LEFT JOIN al sg ON sg.method = nr.floor_arm AND sg.task = nr.task AND sg.grp = nr.grp AND sg.run = nr.run)"""


def floored(spark, sf):
    """Every run's rows with their floor; the floors of two widths have several draws, the third only its own."""
    main, held = holdout(spark, sf)
    rows = main.unionByName(held)
    floors = S.floor_spread(rows.filter(F.col("method").isin("null_random16", "null_random32")))
    out = None
    for run in (0, 1, 2):
        one = S.attach_floor(rows.filter(F.col("run") == run), floors)
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "attach_floor",
    f"WITH {HOLD}, {FLOORED} SELECT run, method, task, grp, floor_arm, round(s, 6) AS s, round(fs, 6) AS floor_s, fd AS floor_draws, round(fsd, 6) AS floor_sd, round(s - fs, 6) AS s_over_floor FROM fd",
)
def attach_floor(spark, sf):
    out = floored(spark, sf).select("run", "method", "task", "grp", "floor_arm", "s", "floor_s", "floor_draws", "floor_sd", "s_over_floor")
    return rounded(out, "s", "floor_s", "floor_sd", "s_over_floor")


@query(
    "run_summary",
    f"""WITH {HOLD}, {FLOORED} SELECT method, task, grp, round(avg(s), 6) AS s, round(avg(fs), 6) AS floor_s, round(avg(s - fs), 6) AS s_over_floor, round(stddev_samp(s - fs), 6) AS s_over_floor_sd, count(DISTINCT run) AS n_runs, min(floor_arm) AS floor_arm FROM fd GROUP BY ALL""",
)
def run_summary(spark, sf):
    """Mean over runs of the score, its floor and the gap."""
    return rounded(S.summary(floored(spark, sf)), "s", "floor_s", "s_over_floor", "s_over_floor_sd")


@query(
    "arm_log",
    f"""WITH {HOLD}, {FLOORED} SELECT method, round(avg(s - fs), 6) AS s_over_floor, count(*) AS n_rows FROM fd WHERE grp = '' GROUP BY 1 ORDER BY 2 DESC""",
)
def arm_log(spark, sf):
    """Arms ordered by their mean gap over the floor."""
    out = floored(spark, sf).filter("grp = ''").groupBy("method").agg(F.avg("s_over_floor").alias("s_over_floor"), F.count(F.lit(1)).alias("n_rows"))
    return rounded(out, "s_over_floor").orderBy(F.col("s_over_floor").desc())


@query(
    "method_task_matrix",
    f"""WITH {RES} SELECT task, {', '.join(f"round(avg(value) FILTER (method = '{m}'), 6) AS {m}" for m in DIMS)} FROM results WHERE NOT diagnostic GROUP BY 1 HAVING count(DISTINCT CASE WHEN value IS NOT NULL THEN method END) = {len(DIMS)}""",
)
def method_task_matrix(spark, sf):
    """Task by method matrix of pooled means, complete tasks only."""
    r = results(spark, sf).filter("NOT diagnostic")
    wide = r.groupBy("task").pivot("method", list(DIMS)).agg(near(F.avg("value")))
    return wide.dropna(subset=list(DIMS))


@query(
    "cell_table",
    f"""WITH {RES} SELECT grp, task, method, seed, round(value, 6) AS value, (row_number() OVER (ORDER BY grp, task, method, seed))::BIGINT AS line FROM results WHERE NOT diagnostic""",
)
def cell_table(spark, sf):
    """Unpooled cells in reading order, numbered.

    The line number is a running count over (group, task) totals plus a position inside one task,
    so no task sorts the table.
    """
    from pyspark.sql import Window

    r = results(spark, sf).filter("NOT diagnostic")
    per = r.groupBy("grp", "task").agg(F.count(F.lit(1)).alias("n"))
    before = per.withColumn("off", F.coalesce(F.sum("n").over(Window.orderBy("grp", "task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    pos = F.row_number().over(Window.partitionBy("grp", "task").orderBy("method", "seed"))
    out = r.withColumn("rn", pos).join(before, ["grp", "task"])
    return rounded(out.select("grp", "task", "method", "seed", "value", (F.col("off") + F.col("rn")).alias("line")), "value")


DIAG = """dg AS (SELECT method, seed, CASE WHEN method = 'arm768' THEN 768 ELSE 32 END AS run_dim,
    CASE method WHEN 'arm32' THEN least(32, 30 + count(*) % 3) WHEN 'arm48' THEN 32 + count(*) % 2 WHEN 'null_random16' THEN 16 WHEN 'null_random32' THEN CASE WHEN seed <> 1 THEN 32 END ELSE 768 END AS emb_dim FROM rd GROUP BY 1, 2)"""


def diagnostics(spark, sf):
    """Asked and fitted width per (arm, seed), the fitted one depending on how many draws the arm has."""
    d = result_draws(spark, sf).groupBy("method", "seed").agg(F.count(F.lit(1)).alias("n"))
    m = F.col("method")
    emb = (
        F.when(m == "arm32", F.least(F.lit(32), 30 + F.col("n") % 3)).when(m == "arm48", 32 + F.col("n") % 2)
        .when(m == "null_random16", 16).when(m == "null_random32", F.when(F.col("seed") != 1, 32)).otherwise(768)
    )
    return d.select("method", "seed", F.when(m == "arm768", 768).otherwise(32).alias("run_dim"), emb.cast("bigint").alias("emb_dim"))


@query(
    "width_fence",
    f"""WITH {RES}, {DIAG}, p(method, declared) AS (VALUES ('null_random16', '16'), ('null_random768', 'input')), x AS (SELECT dg.*, coalesce(declared, 'run') AS declared_width FROM dg LEFT JOIN p USING (method)),
    y AS (SELECT *, CASE WHEN emb_dim IS NULL THEN 'width_not_recorded' WHEN emb_dim = run_dim THEN NULL WHEN declared_width = 'input' THEN 'declared_input_width' WHEN declared_width <> 'run' THEN 'declared_fixed_width'
      WHEN emb_dim < run_dim THEN 'saturated_below_request' ELSE 'wider_than_request' END AS reason FROM x)
    SELECT method, seed, run_dim, emb_dim, emb_dim - run_dim AS delta, declared_width, (declared_width <> 'run')::INT AS declared_fixed, reason FROM y WHERE reason IS NOT NULL""",
)
def width_fence(spark, sf):
    policy = spark.createDataFrame([("null_random16", "16"), ("null_random768", "input")], "method string, declared string")
    return S.width_fence(diagnostics(spark, sf), policy)


@query(
    "pooled_diagnostics",
    f"""WITH {RES}, {DIAG} SELECT method, CASE WHEN count(DISTINCT emb_dim) = 1 THEN max(emb_dim) END AS emb_dim, CASE WHEN count(DISTINCT run_dim) = 1 THEN max(run_dim) END AS run_dim, count(DISTINCT seed) AS n_seeds FROM dg GROUP BY 1""",
)
def pooled_diagnostics(spark, sf):
    """The value all seeds of an arm share, NULL where they disagree."""
    return diagnostics(spark, sf).groupBy("method").agg(
        S.agreed("emb_dim").alias("emb_dim"), S.agreed("run_dim").alias("run_dim"), F.countDistinct("seed").alias("n_seeds")
    )


@query(
    "attach_diagnostics",
    f"""WITH {RES}, {DIAG}, pd AS (SELECT method, CASE WHEN count(DISTINCT emb_dim) = 1 THEN max(emb_dim) END AS emb_dim FROM dg WHERE method <> 'arm48' GROUP BY 1)
    SELECT method, task, round(avg(value), 6) AS mean, any_value(emb_dim) AS emb_dim FROM results LEFT JOIN pd USING (method) GROUP BY 1, 2""",
)
def attach_diagnostics(spark, sf):
    """Diagnostics joined on the arm; an arm without any keeps its rows."""
    pooled = diagnostics(spark, sf).filter("method <> 'arm48'").groupBy("method").agg(S.agreed("emb_dim").alias("emb_dim"))
    means = results(spark, sf).groupBy("method", "task").agg(F.avg("value").alias("mean"))
    return rounded(means.join(pooled, "method", "left").select("method", "task", "mean", "emb_dim"), "mean")


@query(
    "bootstrap_ranks",
    f"""WITH {CELLS}, m AS (SELECT model_id, round(avg(acc), 2) AS y, round(avg(correct), 2) AS p FROM cells GROUP BY 1), {boot_slots('m', '', 'model_id', 20, 'ci')},
    x AS (SELECT draw, y, p, unnest(range(times)) AS copy FROM b_times JOIN m USING (model_id)),
    r AS (SELECT *, {MIDRANK.format(k='draw', x='y')} AS ry, {MIDRANK.format(k='draw', x='p')} AS rp FROM x)
    SELECT (draw - 1)::INT AS draw, round(corr(ry, rp), 6) AS spearman,
      round((sum(rp) FILTER (y >= 0.5) - (count(*) FILTER (y >= 0.5))::DOUBLE * (count(*) FILTER (y >= 0.5) + 1) / 2) / ((count(*) FILTER (y >= 0.5))::DOUBLE * (count(*) FILTER (y < 0.5))), 6) AS auroc,
      round(1 - sum((y - p) * (y - p)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2, round(avg(y), 6) AS mean FROM r GROUP BY 1""",
)
def bootstrap_ranks(spark, sf):
    """Spearman, AUROC, R2 and mean in twenty resamples of the models, from one vector of counts for each model."""
    m = T.cells(spark, sf).groupBy("model_id").agg(F.round(F.avg("acc"), 2).alias("y"), F.round(F.avg("correct"), 2).alias("p"))
    held = staged(IV.weighted(m, IV.draw_weights(m.select("model_id"), "model_id", 20), "model_id", ["model_id"]))
    out = None
    for name in ("spearman", "auroc", "r2", "mean"):
        own = IV.STATISTICS[name](held).withColumnRenamed("stat", name)
        out = own if out is None else out.join(own, "draw")
    return rounded(out, "spearman", "auroc", "r2", "mean")
