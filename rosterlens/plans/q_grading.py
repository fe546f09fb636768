"""Queries on answer extraction and grading over the whole response view."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.functions import extract as X
from rosterlens.functions import grade as G
from rosterlens.operators.routing import BENCH_ADAPTER, resolve
from rosterlens.plans.common_sql import RESPONSES, sql_literal
from rosterlens.plans.q_cells import near
from rosterlens.plans.registry import query
from rosterlens.sources import tables as T

KEY = ["order_id", "line_no", "model_id", "part_id"]
KEYS = ", ".join(KEY)

# ------------------------------------------------ the same steps as SQL text
q = sql_literal


def s_strip(t: str) -> str:
    return f"regexp_replace({t}, {q(chr(94) + chr(92) + 's+|' + chr(92) + 's+$')}, '', 'g')"


def s_first(t: str, p: str) -> str:
    return f"nullif(regexp_extract({t}, {q(p)}, 1), '')"


def s_last(t: str, p: str, g: int) -> str:
    return f"list_extract(regexp_extract_all({t}, {q(p)}, {g}), -1)"


def s_unwrap(t: str) -> str:
    for _ in range(3):
        t = f"regexp_replace({t}, {q(X.LATEX_WRAP)}, {q(chr(92) + '1')}, 'g')"
    return t


def s_last_number(t: str) -> str:
    return s_last(f"replace({t}, ',', '')", X.NUMBER, 0)


def s_special(t: str) -> str:
    return s_strip(f"regexp_replace({t}, {q(X.SPECIAL_TOKEN)}, '', 'g')")


def s_after_think(t: str) -> str:
    tail = f"list_extract(regexp_split_to_array({t}, {q(X.THINK_END)}), -1)"
    return f"CASE WHEN {s_strip(tail)} = '' THEN {t} ELSE {tail} END"


def s_boxed(t: str) -> str:
    """Balanced braces up to three levels deep, which is all the response view nests."""
    inner = r"[^{}]*"
    for _ in range(3):
        inner = rf"[^{{}}]*(?:\{{{inner}\}}[^{{}}]*)*"
    after = f"list_extract(string_split({t}, {q(chr(92) + 'boxed')}), -1)"
    return f"CASE WHEN contains({t}, {q(chr(92) + 'boxed')}) THEN nullif(regexp_extract({after}, {q('^[^{]*' + chr(92) + '{(' + inner + ')' + chr(92) + '}')}, 1), '') END"


def s_last_line(trimmed: str) -> str:
    return f"list_extract(list_filter(string_split({trimmed}, chr(10)), lambda s: {s_strip('s')} <> ''), -1)"


def s_mcq(u: str, ut: str, cls: str) -> str:
    head, stated, last = X.mcq_patterns(cls)
    tried = [s_first(u, head), *[s_first(ut, p) for p in stated], s_last(u, last, 1)]
    return f"upper(coalesce({', '.join(tried)}))"


def s_drop(t: str, *tokens: str) -> str:
    for x in tokens:
        t = f"replace({t}, {q(x)}, '')"
    return t


def s_normal_free(t: str) -> str:
    s = s_drop(s_unwrap(t), "\\left", "\\right", "\\!", "\\,")
    s = s_drop(f"replace({s}, {q(chr(92) + ' ')}, ' ')", "$", "**")
    s = s_strip(f"trim({s_strip(s)}, {q(chr(34) + chr(39) + '`')})")
    s = s_strip(f"rtrim({s}, '.')")
    s = f"(SELECT CASE WHEN z LIKE '{{%' AND z LIKE '%}}' THEN {s_strip('z[2:-2]')} ELSE z END FROM (SELECT {s} AS z))"
    s = s_strip(f"regexp_replace({s}, {q(chr(92) + 's*' + chr(92) + '([^)]*' + chr(92) + ')' + chr(92) + 's*$')}, '', 'g')")
    return f"regexp_replace(lower({s}), {q(chr(92) + 's+')}, ' ', 'g')"


def s_normal_math(t: str) -> str:
    s = f"regexp_replace({s_strip(t)}, {q(chr(92) + chr(92) + 'text' + chr(92) + '{[^}]*' + chr(92) + '}')}, '', 'g')"
    s = s_drop(s, "\\left", "\\right", "\\!", "\\,", "\\ ")
    s = f"replace(replace({s}, {q(chr(92) + 'dfrac')}, {q(chr(92) + 'frac')}), {q(chr(92) + 'tfrac')}, {q(chr(92) + 'frac')})"
    s = f"rtrim({s_drop(s, ' ', '$', chr(92) + '%', '%')}, '.')"
    return f"(SELECT CASE WHEN z LIKE '{{%' AND z LIKE '%}}' THEN z[2:-2] ELSE z END FROM (SELECT {s} AS z))"


FORMS = f"""{RESPONSES}, f0 AS (SELECT *, {s_special('prediction')} AS t FROM responses),
  f1 AS (SELECT *, {s_after_think('t')} AS k, {s_strip('t')} AS tt, {s_unwrap('t')} AS u FROM f0),
  f2 AS (SELECT *, {s_strip('u')} AS ut, {s_unwrap('k')} AS ku, {s_strip('k')} AS kt FROM f1),
  forms AS (SELECT *, {s_strip('ku')} AS kut FROM f2)"""


def staged(spark, sf):
    df, t = X.stage(T.responses(spark, sf), X.strip_special_tokens(F.col("prediction")), "t")
    df, k = X.stage(df, X.after_think(t.raw), "k", t)
    return df, t, k


# ------------------------------------------------ queries
@query("strip_special_tokens", f"WITH {FORMS} SELECT {KEYS}, t AS text FROM forms")
def strip_special_tokens(spark, sf):
    return T.responses(spark, sf).select(*KEY, X.strip_special_tokens(F.col("prediction")).alias("text"))


@query("after_think", f"WITH {FORMS} SELECT {KEYS}, k AS text FROM forms")
def after_think(spark, sf):
    df, t, k = staged(spark, sf)
    return df.select(*KEY, k.raw.alias("text"))


@query("unwrap_latex", f"WITH {FORMS} SELECT {KEYS}, u AS text FROM forms")
def unwrap_latex(spark, sf):
    df, t, k = staged(spark, sf)
    return df.select(*KEY, t.unwrapped.alias("text"))


@query("extract_boxed", f"WITH {FORMS} SELECT {KEYS}, {s_boxed('t')} AS answer FROM forms")
def extract_boxed(spark, sf):
    df, t, k = staged(spark, sf)
    return df.select(*KEY, t.boxed.alias("answer"))


@query("extract_mcq", f"WITH {FORMS} SELECT {KEYS}, {s_mcq('u', 'ut', '[A-Za-z]')} AS answer FROM forms")
def extract_mcq(spark, sf):
    df, t, k = staged(spark, sf)
    return df.select(*KEY, X.mcq(t).alias("answer"))


@query(
    "extract_mcq_by_choices",
    f"""WITH {FORMS} SELECT {KEYS}, CASE 2 + part_id % 4
      WHEN 2 THEN {s_mcq('u', 'ut', '[A-Ba-b]')} WHEN 3 THEN {s_mcq('u', 'ut', '[A-Ca-c]')}
      WHEN 4 THEN {s_mcq('u', 'ut', '[A-Da-d]')} ELSE {s_mcq('u', 'ut', '[A-Ea-e]')} END AS answer FROM forms""",
)
def extract_mcq_by_choices(spark, sf):
    """The number of options differs per item."""
    df, t, k = staged(spark, sf)
    return df.select(*KEY, X.mcq(t, F.lit(2) + F.col("part_id") % 4).alias("answer"))


@query(
    "extract_think_first",
    f"WITH {FORMS} SELECT {KEYS}, coalesce({s_mcq('ku', 'kut', '[A-Za-z]')}, {s_mcq('u', 'ut', '[A-Za-z]')}) AS answer FROM forms",
)
def extract_think_first(spark, sf):
    df, t, k = staged(spark, sf)
    return df.select(*KEY, X.think_first(X.mcq, t, k).alias("answer"))


S_FREE = f"coalesce({s_boxed('t')}, {s_first('t', X.FREE_FINAL)}, {s_first('t', X.FREE_STATED)}, {s_last_line('tt')})"
S_FREE_K = f"coalesce({s_boxed('k')}, {s_first('k', X.FREE_FINAL)}, {s_first('k', X.FREE_STATED)}, {s_last_line('kt')})"


@query("extract_free", f"WITH {FORMS} SELECT {KEYS}, {S_FREE} AS answer FROM forms")
def extract_free(spark, sf):
    df, t, k = staged(spark, sf)
    return df.select(*KEY, X.free(t).alias("answer"))


FENCED = "'Plan.' || chr(10) || '```python' || chr(10) || prediction || chr(10) || '```' || CASE line_no % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '```py' || chr(10) || 'x=1' || chr(10) || '```' ELSE chr(10) || '```' || chr(10) || 'open' END"


@query(
    "extract_code",
    f"""WITH {RESPONSES}, c AS (SELECT *, {FENCED} AS t FROM responses), d AS (SELECT *, {s_after_think('t')} AS k FROM c)
    SELECT {KEYS}, coalesce({s_last('k', X.CODE_FENCE, 1)}, {s_last('t', X.CODE_FENCE, 1)}, {s_first('t', X.CODE_OPEN)}, t) AS answer FROM d""",
)
def extract_code(spark, sf):
    """Responses wrapped in fences of three shapes, one left open."""
    tail = (
        F.when(F.col("line_no") % 3 == 0, F.lit(""))
        .when(F.col("line_no") % 3 == 1, F.lit("\n```py\nx=1\n```"))
        .otherwise(F.lit("\n```\nopen"))
    )
    text = F.concat(F.lit("Plan.\n```python\n"), F.col("prediction"), F.lit("\n```"), tail)
    df, t = X.stage(T.responses(spark, sf), text, "t")
    df, k = X.stage(df, X.after_think(t.raw), "k", t)
    return df.select(*KEY, X.code(t, k).alias("answer"))


@query("last_number", f"WITH {FORMS} SELECT {KEYS}, {s_last_number('t')} AS answer FROM forms")
def last_number(spark, sf):
    df, t, k = staged(spark, sf)
    return df.select(*KEY, X.last_number(t.raw).alias("answer"))


S_GSM = f"coalesce({s_last_number(s_first('t', X.GSM_BOXED))}, {', '.join('replace(' + s_first('t', p) + ', chr(44), chr(32)[2:])' for p in X.GSM_STATED)}, {s_last_number('t')})"
S_MATH = f"coalesce({s_boxed('t')}, {', '.join(s_strip(s_first('t', p)) for p in X.MATH_STATED)}, {s_last_number('t')})"
S_GPQA = f"upper(coalesce({s_first('u', X.GPQA_BOXED)}, {', '.join(s_first('ut', p) for p in X.GPQA_STATED)}, {s_last('u', X.GPQA_LAST, 1)}))"
S_BBH = f"upper(coalesce({s_first('u', X.BBH_BOXED)}, {', '.join(s_first('ut', p) for p in X.BBH_STATED)}, {s_last('u', X.BBH_LAST, 1)}))"
S_BBH_FREE = f"coalesce({s_boxed('t')}, {', '.join(s_first('t', p) for p in X.BBH_FREE)}, {s_last_line('tt')}, t)"


@query("extract_gsm8k", f"WITH {FORMS} SELECT {KEYS}, {S_GSM} AS answer FROM forms")
def extract_gsm8k(spark, sf):
    df, t, k = staged(spark, sf)
    return df.select(*KEY, X.gsm8k(t).alias("answer"))


@query("extract_math", f"WITH {FORMS} SELECT {KEYS}, {S_MATH} AS answer FROM forms")
def extract_math(spark, sf):
    df, t, k = staged(spark, sf)
    return df.select(*KEY, X.math(t).alias("answer"))


@query("extract_gpqa", f"WITH {FORMS} SELECT {KEYS}, {S_GPQA} AS answer FROM forms")
def extract_gpqa(spark, sf):
    df, t, k = staged(spark, sf)
    return df.select(*KEY, X.gpqa(t).alias("answer"))


@query("extract_bbh", f"WITH {FORMS} SELECT {KEYS}, {S_BBH} AS letter, {S_BBH_FREE} AS free FROM forms")
def extract_bbh(spark, sf):
    df, t, k = staged(spark, sf)
    return df.select(*KEY, X.bbh_letter(t).alias("letter"), X.bbh_free(t).alias("free"))


WRAPPED = "' $\\mathrm{' || prediction || '}$. (items) '"


@query(
    "normalise_free",
    f"WITH {RESPONSES} SELECT {KEYS}, {s_normal_free(WRAPPED)} AS text FROM responses",
)
def normalise_free(spark, sf):
    text = F.concat(F.lit(" $\\mathrm{"), F.col("prediction"), F.lit("}$. (items) "))
    return T.responses(spark, sf).select(*KEY, G.normal_free(text).alias("text"))


FLOAT = G.FLOAT


def s_number(t: str) -> str:
    return f"CASE WHEN regexp_matches({s_strip(t)}, {q(FLOAT)}) THEN TRY_CAST({s_strip(t)} AS DOUBLE) END"


def s_free_match(p: str, g: str) -> str:
    return f"coalesce({p} = {g} OR coalesce(abs({s_number(s_drop(p, ','))} - {s_number(s_drop(g, ','))}) < 1e-6, false), false)"


@query(
    "free_match",
    f"""WITH {RESPONSES}, n AS (SELECT {KEYS}, {s_normal_free("model_id || '.0'")} AS p, {s_normal_free("'$' || (part_id % 50) || '$'")} AS g FROM responses)
    SELECT {KEYS}, ({s_free_match('p', 'g')})::INT AS matched FROM n""",
)
def free_match(spark, sf):
    """Numbers written differently on the two sides."""
    p = F.concat(F.col("model_id").cast("string"), F.lit(".0"))
    g = F.concat(F.lit("$"), (F.col("part_id") % 50).cast("string"), F.lit("$"))
    df = T.responses(spark, sf).select(*KEY, G.normal_free(p).alias("p"), G.normal_free(g).alias("g"))
    return df.select(*KEY, G.free_match(F.col("p"), F.col("g")).cast("int").alias("matched"))


# ------------------------------------------------ routing and dispatch
BENCHES = ("mmlu", "gsm8k", "math", "gpqa", "bbh", "asdiv", "humaneval", "mmlu_algebra", "novel_set", "gpqa_diamond", "aime_2024")
MARKERS = ("7",)


def items(spark, sf):
    """Responses with a benchmark per item, a gold answer, and an item format on some items."""
    names = F.array(*[F.lit(b) for b in BENCHES])
    letters = F.col("bench").isin("mmlu", "gpqa", "bbh", "mmlu_algebra", "gpqa_diamond")
    same = F.col("model_id") % 3 == 0
    number = F.when(same, F.col("part_id").cast("string")).otherwise(F.col("gold_number"))
    letter = F.when(same, F.char(F.lit(65) + F.col("part_id") % 4)).otherwise(F.col("gold_letter"))
    return (
        T.responses(spark, sf)
        .withColumn("bench", F.get(names, (F.col("part_id") % len(BENCHES)).cast("int")))
        .withColumn("model", F.concat(F.lit("m"), F.col("model_id").cast("string")))
        .withColumn("gold", F.when(letters, letter).otherwise(number))
        .withColumn("fmt", F.when(F.col("part_id") % 13 == 0, "free").when(F.col("part_id") % 13 == 1, "mcq"))
    )


def _routes_sql() -> str:
    rows = ", ".join(f"('{b}', '{a}')" for b, a in BENCH_ADAPTER.items())
    return f"routes(rb, ra) AS (VALUES {rows})"


ITEMS = f"""{FORMS}, i0 AS (SELECT *, [{', '.join(q(b) for b in BENCHES)}][1 + part_id % {len(BENCHES)}] AS bench, 'm' || model_id AS model,
    CASE part_id % 13 WHEN 0 THEN 'free' WHEN 1 THEN 'mcq' END AS fmt FROM forms),
  i1 AS (SELECT *, CASE WHEN bench IN ('mmlu', 'gpqa', 'bbh', 'mmlu_algebra', 'gpqa_diamond')
      THEN CASE WHEN model_id % 3 = 0 THEN chr((65 + part_id % 4)::INT) ELSE gold_letter END
      ELSE CASE WHEN model_id % 3 = 0 THEN part_id::VARCHAR ELSE gold_number END END AS gold FROM i0),
  {_routes_sql()},
  i2 AS (SELECT i1.*, coalesce(e.ra, p.ra) AS entry, contains(model, '7') AS thinks FROM i1 LEFT JOIN routes e ON e.rb = bench
     LEFT JOIN routes p ON p.rb = CASE WHEN bench LIKE 'mmlu\\_%' ESCAPE '\\' THEN 'mmlu' WHEN bench LIKE 'gpqa\\_%' ESCAPE '\\' THEN 'gpqa' END),
  i3 AS (SELECT *, CASE WHEN entry IN ('mcq', 'free') AND thinks THEN entry || '_think' ELSE coalesce(entry, CASE WHEN bench IN ('gsm8k', 'math', 'gpqa', 'bbh') THEN 'legacy' ELSE 'free' END) END AS tab FROM i2),
  items AS (SELECT *, (entry IS NOT NULL)::INT AS routed, CASE WHEN tab <> 'legacy' AND fmt IS NOT NULL AND fmt <> replace(tab, '_think', '')
     THEN CASE WHEN tab LIKE '%\\_think' ESCAPE '\\' THEN fmt || '_think' ELSE fmt END ELSE tab END AS adapter FROM i3)"""


@query(
    "resolve_adapter",
    f"WITH {ITEMS} SELECT bench, thinks::INT AS thinks, fmt, adapter, routed, count(*) AS n FROM items GROUP BY ALL",
)
def resolve_adapter(spark, sf):
    from rosterlens.operators.routing import model_class

    df = resolve(items(spark, sf), "bench", "model", MARKERS, "fmt")
    thinks = (model_class("model", MARKERS) == "@reasoning").cast("int")
    return df.groupBy("bench", thinks.alias("thinks"), "fmt", "adapter", "routed").agg(F.count(F.lit(1)).alias("n"))


@query(
    "unrouted_benchmarks",
    f"WITH {ITEMS} SELECT bench, count(*) AS n FROM items WHERE routed = 0 GROUP BY 1 ORDER BY 1",
)
def unrouted_benchmarks(spark, sf):
    return (
        resolve(items(spark, sf), "bench", "model", MARKERS)
        .filter(F.col("routed") == 0)
        .groupBy("bench")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("bench")
    )


S_EXTRACTED = f"""CASE WHEN adapter = 'mcq' THEN {s_mcq('u', 'ut', '[A-Za-z]')}
   WHEN adapter = 'mcq_think' THEN coalesce({s_mcq('ku', 'kut', '[A-Za-z]')}, {s_mcq('u', 'ut', '[A-Za-z]')})
   WHEN adapter = 'free' THEN {S_FREE} WHEN adapter = 'free_think' THEN coalesce({S_FREE_K}, {S_FREE})
   WHEN adapter = 'code' THEN coalesce({s_last('k', X.CODE_FENCE, 1)}, {s_last('t', X.CODE_FENCE, 1)}, {s_first('t', X.CODE_OPEN)}, t)
   WHEN adapter = 'legacy' AND bench = 'gsm8k' THEN {S_GSM} WHEN adapter = 'legacy' AND bench = 'math' THEN {S_MATH}
   WHEN adapter = 'legacy' AND bench = 'gpqa' THEN {S_GPQA} END"""

GRADED = f"""{ITEMS}, g1 AS (SELECT *, {S_EXTRACTED} AS extracted FROM items),
  g2 AS (SELECT *, {s_normal_free('extracted')} AS pn, {s_normal_free('gold')} AS gn, {s_normal_math('extracted')} AS pm, {s_normal_math('gold')} AS gm FROM g1),
  graded AS (SELECT {KEYS}, bench, adapter, extracted, CASE
     WHEN adapter LIKE 'mcq%' THEN coalesce(extracted = upper({s_strip('gold')}), false)
     WHEN adapter LIKE 'free%' THEN {s_free_match('pn', 'gn')}
     WHEN adapter = 'code' THEN false
     WHEN adapter = 'legacy' AND bench = 'gsm8k' THEN coalesce(CASE WHEN {s_number('extracted')} IS NOT NULL AND {s_number('gold')} IS NOT NULL
        THEN abs({s_number('extracted')} - {s_number('gold')}) < 1e-4 ELSE {s_strip('extracted')} = {s_strip('gold')} END, false)
     WHEN adapter = 'legacy' AND bench = 'math' THEN coalesce(pm = gm, false)
     WHEN adapter = 'legacy' AND bench = 'gpqa' THEN coalesce(extracted = upper(gold), false)
     WHEN adapter = 'legacy' AND bench = 'bbh' THEN coalesce({S_BBH} = gold, false) END AS graded FROM g2)"""


def graded(spark, sf):
    df = resolve(items(spark, sf), "bench", "model", MARKERS, "fmt")
    return G.grade_responses(df, "adapter", "bench", "prediction", "gold")


@query("grade_answers", f"WITH {GRADED} SELECT {KEYS}, bench, adapter, extracted, graded::INT AS graded FROM graded")
def grade_answers(spark, sf):
    """Route, extract and grade every response in one pass."""
    return graded(spark, sf).select(*KEY, "bench", "adapter", "extracted", F.col("graded").cast("int").alias("graded"))


@query(
    "graded_accuracy",
    f"WITH {GRADED} SELECT model_id, bench, count(*) AS n, round(avg(graded::INT), 6) AS accuracy FROM graded GROUP BY 1, 2",
)
def graded_accuracy(spark, sf):
    out = graded(spark, sf).groupBy("model_id", "bench").agg(
        F.count(F.lit(1)).alias("n"), near(F.avg(F.col("graded").cast("int"))).alias("accuracy")
    )
    return out


@query(
    "recorded_join",
    f"""WITH {RESPONSES}, p AS (SELECT DISTINCT p_partkey AS part_id FROM part), m AS (SELECT DISTINCT model_id FROM responses),
    got AS (SELECT model_id, part_id, arg_max(prediction, order_id * 8 + line_no) AS prediction FROM responses GROUP BY 1, 2)
    SELECT model_id, count(*) AS n_recorded, (SELECT count(*) FROM p) - count(*) AS n_missing,
      sum(len(list_filter(regexp_split_to_array({s_strip('prediction')}, {q(chr(92) + 's+')}), lambda w: w <> '')))::BIGINT AS n_tok
    FROM got SEMI JOIN p USING (part_id) GROUP BY 1""",
)
def recorded_join(spark, sf):
    """Probe items joined with recorded answers: later duplicates win, missing answers leave no row."""
    probe = T.table(spark, sf, "part").select(F.col("p_partkey").alias("part_id"))
    at = F.col("order_id") * 8 + F.col("line_no")
    got = (
        T.responses(spark, sf)
        .groupBy("model_id", "part_id")
        .agg(F.max_by("prediction", at).alias("prediction"))
        .join(probe, "part_id", "left_semi")
    )
    words = F.size(F.filter(F.split(X.strip(F.col("prediction")), X.java(r"\s+")), lambda w: w != ""))
    n_probe = probe.agg(F.count(F.lit(1))).scalar()
    return got.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_recorded"),
        (n_probe - F.count(F.lit(1))).alias("n_missing"),
        F.sum(words).alias("n_tok"),
    )


@query(
    "config_fingerprint",
    """SELECT s_suppkey AS model_id, substr(sha256('{"draws": ' || (1 + s_suppkey % 3) || ', "max_tokens": ' || (CASE WHEN contains(s_name, '7') THEN 12288 ELSE 3072 END)
        || ', "model": "' || s_name || '", "temperature": ' || (CASE WHEN contains(s_name, '7') THEN '0.6' ELSE '0.0' END) || '}'), 1, 12) AS config_hash FROM supplier""",
)
def config_fingerprint(spark, sf):
    """Settings hash: sorted-key JSON, first 12 hex digits of its SHA-256."""
    from rosterlens.operators.routing import generation_budget
    from rosterlens.sources.files import config_hash

    df = T.models(spark, sf).withColumn("b", generation_budget("name", ("7",)))
    return df.select(
        "model_id",
        config_hash(F.lit(1) + F.col("model_id") % 3, F.col("b.max_new_tokens"), F.col("name"), F.col("b.temperature")).alias("config_hash"),
    )



