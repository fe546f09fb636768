"""Queries on answer vectors, pairs, neighbours and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from rosterlens.functions import ranks as R
from rosterlens.functions import vectors as V
from rosterlens.functions.draws import draw_index, keyed_hash
from rosterlens.operators import banks as B
from rosterlens.operators import duplicates as D
from rosterlens.operators import embed as E
from rosterlens.operators import neighbours as N
from rosterlens.operators import pairs as PR
from rosterlens.operators import splits as P
from rosterlens.plans.common_sql import CELLS, MODELS, QUESTIONS, h
from rosterlens.plans.q_cells import near, rounded
from rosterlens.plans.q_splits import FOLDS, MIDRANK, AUC, blocks
from rosterlens.plans.registry import query
from rosterlens.session import staged
from rosterlens.sources import tables as T

DIM = 64

ANSWERS = f"""ans0 AS (SELECT model_id, question_id, {h("'0'", "'answer'", 'model_id', 'question_id')} % (SELECT count(*) FROM embeddings) AS vec_id FROM cells),
  answers AS (SELECT model_id, question_id, embedding::DOUBLE[] AS emb FROM ans0 JOIN embeddings USING (vec_id))"""
QEMB = f"""q0 AS (SELECT question_id, {h("'0'", "'question'", 'question_id')} % (SELECT count(*) FROM embeddings) AS vec_id FROM questions),
  question_emb AS (SELECT question_id, embedding::DOUBLE[] AS emb FROM q0 JOIN embeddings USING (vec_id))"""


def rvec(expr: str, digits: int = 6) -> str:
    return f"list_transform({expr}, lambda x: round(x, {digits}))"


def rounded_vec(df, name, digits=6):
    return df.withColumn(name, F.transform(name, lambda x: near(x.cast("double"), digits)))


def answers(spark, sf, cells=None, by=None):
    return B.answer_vectors(T.cells(spark, sf) if cells is None else cells, T.vectors(spark, sf), by=by)


def question_emb(spark, sf):
    return B.question_vectors(T.questions(spark, sf), T.vectors(spark, sf))


def pooled(spark, sf, cells=None):
    return B.pooled_text(answers(spark, sf, cells, by="model_id"))


LONGSUM = "(SELECT model_id, i, avg(x) AS m, count(*) AS n FROM (SELECT model_id, unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM answers) GROUP BY 1, 2)"
POOLED = f"""pl AS (SELECT model_id, list(m ORDER BY i) AS v, max(n) AS n_answers FROM {LONGSUM} GROUP BY 1),
  pooled AS (SELECT model_id, n_answers, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS emb FROM pl)"""


@query("answer_bank", f"WITH {CELLS}, {ANSWERS} SELECT model_id, question_id, len(emb)::INT AS width, round(list_sum(list_transform(emb, lambda x: x * x)), 4) AS sq FROM answers")
def answer_bank(spark, sf):
    """Every cell with its answer vector; an uncovered cell has no row."""
    return answers(spark, sf).select(
        "model_id", "question_id", F.size("emb").alias("width"), F.round(V.dot("emb", "emb"), 4).alias("sq")
    )


@query(
    "bank_alignment",
    f"""WITH {CELLS}, {ANSWERS} SELECT (SELECT count(*) FROM cells ANTI JOIN answers USING (model_id, question_id)) AS cells_without_vector,
    (SELECT count(*) FROM answers ANTI JOIN cells USING (model_id, question_id)) AS vectors_without_cell, (SELECT count(*) FROM answers WHERE len(emb) <> 64) AS wrong_width""",
)
def bank_alignment(spark, sf):
    """The bank and the cell table must describe the same cut."""
    a, c = answers(spark, sf), T.cells(spark, sf)
    key = ["model_id", "question_id"]
    none = a.filter(F.size("emb") != DIM).agg(F.count(F.lit(1)).alias("wrong_width"))
    return none.select(
        c.join(a, key, "left_anti").agg(F.count(F.lit(1))).scalar().alias("cells_without_vector"),
        a.join(c, key, "left_anti").agg(F.count(F.lit(1))).scalar().alias("vectors_without_cell"),
        "wrong_width",
    )


@query("pooled_text", f"WITH {CELLS}, {ANSWERS}, {POOLED} SELECT model_id, n_answers, {rvec('emb')} AS emb FROM pooled")
def pooled_text(spark, sf):
    return rounded_vec(pooled(spark, sf), "emb")


@query(
    "interview_text",
    f"""WITH {CELLS}, {MODELS}, {ANSWERS.replace('FROM cells)', "FROM cells WHERE question_id LIKE 'Brand#1|%' AND model_id % 3 <> 0)")}, {POOLED},
    mu AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM pooled WHERE model_id % 5 <> 0) GROUP BY 1))
    SELECT model_id, {rvec('coalesce(emb, mu)')} AS emb FROM models LEFT JOIN pooled USING (model_id), mu""",
)
def interview_text(spark, sf):
    """Pooled text over the interview questions; models without text take the training mean."""
    asked = T.cells(spark, sf).filter(F.col("question_id").startswith("Brand#1|") & (F.col("model_id") % 3 != 0))
    pooled_rows = B.pooled_text(B.answer_vectors(asked, T.vectors(spark, sf)), T.models(spark, sf))
    out = B.filled_with_mean(pooled_rows, F.col("model_id") % 5 != 0)
    return rounded_vec(out.select("model_id", "emb"), "emb")


@query(
    "question_block_vectors",
    f"""WITH {CELLS}, {QUESTIONS}, {QEMB}, c AS (SELECT model_id, question_id, correct - avg(correct) OVER (PARTITION BY question_id) AS v FROM cells),
    l AS (SELECT model_id, i, sum(v * x) AS s FROM (SELECT model_id, v, unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM c JOIN question_emb USING (question_id)) GROUP BY 1, 2)
    SELECT model_id, {rvec('list(s / (SELECT count(*) FROM questions) ORDER BY i)', 5)} AS emb FROM l GROUP BY 1""",
)
def question_block_vectors(spark, sf):
    return rounded_vec(B.question_block(T.cells(spark, sf), question_emb(spark, sf)), "emb", 5)


SCALE = "CASE WHEN top > 0 THEN (top::DOUBLE / 127.0::DOUBLE)::FLOAT ELSE 1::FLOAT END"


@query(
    "pack_bank",
    f"""WITH t AS (SELECT vec_id, embedding AS e, list_max(list_transform(embedding, lambda x: abs(x))) AS top FROM embeddings),
    s AS (SELECT *, {SCALE} AS scale FROM t) SELECT vec_id, round(scale::DOUBLE, 9) AS scale, list_transform(e, lambda x: round_even((x / scale)::DOUBLE, 0)::INT) AS q FROM s""",
)
def pack_bank(spark, sf):
    p = B.pack(T.vectors(spark, sf))
    return p.select("vec_id", F.round(F.col("scale").cast("double"), 9).alias("scale"), F.transform("q", lambda x: x.cast("int")).alias("q"))


@query(
    "unpack_bank",
    f"""WITH t AS (SELECT vec_id, embedding AS e, list_max(list_transform(embedding, lambda x: abs(x))) AS top FROM embeddings),
    s AS (SELECT *, {SCALE} AS scale FROM t), u AS (SELECT vec_id, e, list_transform(e, lambda x: (round_even((x / scale)::DOUBLE, 0)::FLOAT * scale)::FLOAT) AS r FROM s)
    SELECT vec_id, {rvec('list_transform(r, lambda x: x::DOUBLE)')} AS emb,
      (list_dot_product(e::DOUBLE[], r::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]) * list_dot_product(r::DOUBLE[], r::DOUBLE[])) > 0.999)::INT AS close FROM u""",
)
def unpack_bank(spark, sf):
    """Packed and unpacked again: the direction of every vector survives."""
    v = T.vectors(spark, sf)
    u = B.unpack(B.pack(v)).select("vec_id", F.col("emb").alias("r"))
    both = v.join(u, "vec_id")
    cos = V.dot("emb", "r") / F.sqrt(V.dot("emb", "emb") * V.dot("r", "r"))
    return rounded_vec(both.select("vec_id", F.col("r").alias("emb"), (cos > 0.999).cast("int").alias("close")), "emb")


@query(
    "part_gaps",
    """WITH m AS (SELECT s_nationkey AS part, count(*) AS n FROM supplier GROUP BY 1), p AS (SELECT part, sum(n) OVER (ORDER BY part) - n AS row_start, sum(n) OVER (ORDER BY part) AS row_end FROM m),
    k AS (SELECT * FROM p WHERE part NOT IN (7, 13)) SELECT row_start::BIGINT AS at, 'no part ends here' AS problem FROM k WHERE row_start > 0 AND row_start NOT IN (SELECT row_end FROM k)
    UNION ALL SELECT max(row_end)::BIGINT, 'rows are missing at the end' FROM k HAVING max(row_end) <> (SELECT count(*) FROM supplier)""",
)
def part_gaps(spark, sf):
    """Packed parts must be contiguous; here the parts of two nations are lost."""
    from pyspark.sql import Window

    per = T.table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    end = F.sum("n").over(Window.orderBy("s_nationkey"))  # one row per part file
    n = T.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    parts = per.select("s_nationkey", (end - F.col("n")).alias("row_start"), end.alias("row_end")).withColumn("n_models", n)
    return B.part_gaps(parts.filter(~F.col("s_nationkey").isin(7, 13)))


@query(
    "question_discrepancy",
    f"""WITH {CELLS}, {ANSWERS}, u AS (SELECT question_id, list_transform(emb, lambda x: x / sqrt(list_dot_product(emb, emb))) AS e FROM answers),
    l AS (SELECT question_id, i, sum(x) AS s, count(*) AS n FROM (SELECT question_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM u) GROUP BY 1, 2),
    g AS (SELECT question_id, sum(s * s) AS sq, max(n) AS n FROM l GROUP BY 1)
    SELECT question_id, round(CASE WHEN n >= 2 THEN 1 - (sq - n) / (n * (n - 1.0::DOUBLE)) ELSE 0 END, 6) AS score, round(n::DOUBLE / (SELECT count(*) FROM supplier), 6) AS coverage FROM g""",
)
def question_discrepancy(spark, sf):
    """Mean pairwise cosine distance of the answers to a question, from sums only."""
    n = T.table(spark, sf, "supplier").agg(F.count(F.lit(1))).scalar()
    return rounded(B.discrepancy(answers(spark, sf), n), "score", "coverage")


@query("table_digest")
def table_digest(spark, sf):
    """Order-free digest of the cell table."""
    return B.digest(T.cells(spark, sf))


# ------------------------------------------------ near duplicates
BRANDBITS = """bb AS (SELECT l_suppkey AS model_id, replace(p_brand, 'Brand#', '')::INT - 1 AS ix, (avg((l_quantity > 25)::INT) > 0.5)::INT AS bit FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def brand_bits(spark, sf):
    """One majority bit per brand and model: 25 bits."""
    line = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("model_id"), F.col("l_partkey").alias("p_partkey"), (F.col("l_quantity") > 25).cast("int").alias("c"))
    part = T.table(spark, sf, "part").select("p_partkey", (F.replace("p_brand", F.lit("Brand#"), F.lit("")).cast("int") - 1).alias("ix"))
    return line.join(part, "p_partkey").groupBy("model_id", "ix").agg((F.avg("c") > 0.5).cast("int").alias("bit"))


@query(
    "near_duplicates",
    f"""WITH {BRANDBITS}, w AS (SELECT model_id, sum(bit * (1::BIGINT << ix))::BIGINT AS w FROM bb GROUP BY 1), r AS (SELECT w, min(model_id) AS rep, count(*) AS n FROM w GROUP BY 1)
    SELECT a.rep AS model_a, b.rep AS model_b, round(1 - bit_count(xor(a.w, b.w)) / 25.0::DOUBLE, 6) AS agreement, a.n AS n_a, b.n AS n_b
    FROM r a JOIN r b ON a.rep < b.rep WHERE 1 - bit_count(xor(a.w, b.w)) / 25.0::DOUBLE >= 0.84 - 1e-12""",
)
def near_duplicates(spark, sf):
    """Pairs that agree on at least 84% of the bits, found through equal bands."""
    return rounded(D.near_duplicates(D.pack_bits(brand_bits(spark, sf), 25), 25, 0.84), "agreement")


@query(
    "identical_models",
    f"""WITH {BRANDBITS}, w AS (SELECT model_id, sum(bit * (1::BIGINT << ix))::BIGINT AS w FROM bb GROUP BY 1) SELECT model_id, min(model_id) OVER (PARTITION BY w) AS rep FROM w""",
)
def identical_models(spark, sf):
    return D.classes(D.pack_bits(brand_bits(spark, sf), 25))


# ------------------------------------------------ preference pairs
PAIRS = f"""pq AS (SELECT question_id, sum(correct)::BIGINT AS r, sum(1 - correct)::BIGINT AS l FROM cells GROUP BY 1),
  pw AS (SELECT *, (r * l)::DOUBLE AS w FROM pq WHERE r * l > 0), pc AS (SELECT *, sum(w) OVER (ORDER BY {h("'7'", "'pair-q'", 'question_id')}, question_id) AS cum, (SELECT sum(w) FROM pw) AS total FROM pw),
  pe AS (SELECT *, total <= {{n}} AS every FROM pc),
  pd AS (SELECT question_id, r, l, every, unnest(range(CASE WHEN every THEN w ELSE floor(cum / total * {{n}}) - floor((cum - w) / total * {{n}}) END::BIGINT)) AS i FROM pe),
  pp AS (SELECT question_id, correct, model_id, row_number() OVER (PARTITION BY question_id, correct ORDER BY {h("'7'", "'pair-m'", 'question_id', 'model_id')}, model_id) AS pos FROM cells),
  pairs AS (SELECT d.question_id, d.i, a.model_id AS winner, b.model_id AS loser FROM pd d
    JOIN pp a ON a.question_id = d.question_id AND a.correct = 1 AND a.pos = CASE WHEN every THEN i // l ELSE {h("'7'", "'pair-win'", 'd.question_id', 'i')} % r END + 1
    JOIN pp b ON b.question_id = d.question_id AND b.correct = 0 AND b.pos = CASE WHEN every THEN i % l ELSE {h("'7'", "'pair-lose'", 'd.question_id', 'i')} % l END + 1)"""


@query("preference_pairs", f"WITH {CELLS}, {PAIRS.format(n=20000)} SELECT question_id, i, winner, loser FROM pairs")
def preference_pairs(spark, sf):
    """A seeded sample of 20,000 winner/loser pairs."""
    return PR.correctness_pairs(T.cells(spark, sf), 20000, 7)


@query("bradley_terry")
def bradley_terry(spark, sf):
    out = PR.bradley_terry(PR.correctness_pairs(T.cells(spark, sf), 20000, 7), steps=10)
    return rounded(out, "strength")


# ------------------------------------------------ neighbours
SIMS = """sims AS (SELECT a.model_id, b.model_id AS other, list_dot_product(a.emb, b.emb) / (sqrt(list_dot_product(a.emb, a.emb)) * sqrt(list_dot_product(b.emb, b.emb))) AS sim FROM pooled a JOIN pooled b ON a.model_id <> b.model_id),
  near AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY round(sim, 12) DESC, other) AS pos FROM sims QUALIFY pos <= 5)"""


@query("nearest_models", f"WITH {CELLS}, {ANSWERS}, {POOLED}, {SIMS} SELECT model_id, other, round(sim, 6) AS sim, pos::INT AS pos FROM near")
def nearest_models(spark, sf):
    """The five most similar models by pooled text."""
    return rounded(N.nearest(pooled(spark, sf), 5), "sim")


PREDN = """nw0 AS (SELECT *, greatest(sim, 0) AS w0, sum(greatest(sim, 0)) OVER (PARTITION BY model_id) AS tw FROM near), nw AS (SELECT model_id, other, CASE WHEN tw <= 1e-9 THEN 1 ELSE w0 END AS w FROM nw0),
  np AS (SELECT nw.model_id, c.question_id, sum(w * c.acc) / any_value(t) AS predicted FROM nw JOIN (SELECT model_id, sum(w) AS t FROM nw GROUP BY 1) USING (model_id) JOIN cells c ON c.model_id = nw.other GROUP BY 1, 2)"""


def neighbour_rows(spark, sf, cells):
    return N.neighbour_predict(N.nearest(pooled(spark, sf, cells), 5), cells)


@query("neighbour_predictions", f"WITH {CELLS}, {ANSWERS}, {POOLED}, {SIMS}, {PREDN} SELECT model_id, question_id, round(predicted, 6) AS predicted FROM np")
def neighbour_predictions(spark, sf):
    """Every model's row predicted from its neighbours' cells."""
    return rounded(neighbour_rows(spark, sf, staged(T.cells(spark, sf))), "predicted")


@query(
    "correctness_forecasting",
    f"""WITH {CELLS}, {ANSWERS}, {POOLED}, {SIMS}, {PREDN}, x AS (SELECT c.question_id, c.acc, round(coalesce(predicted, 0), 9) AS p FROM cells c LEFT JOIN np USING (model_id, question_id)),
    r AS (SELECT *, (acc >= 0.5)::INT AS y, {MIDRANK.format(k='question_id', x='p')} AS rk FROM x), a AS ({AUC.format(k='question_id', src='r')})
    SELECT round(avg(auroc), 6) AS auroc_mean, count(auroc) AS n_questions, count(*) - count(auroc) AS n_constant FROM a""",
)
def correctness_forecasting(spark, sf):
    """Per-question AUROC of the neighbour predictions, averaged over the questions with both classes."""
    cells = staged(T.cells(spark, sf))
    x = cells.join(neighbour_rows(spark, sf, cells), ["model_id", "question_id"], "left").withColumn(
        "p", F.round(F.coalesce("predicted", F.lit(0.0)), 9)
    )
    a = R.auroc(staged(x.select("question_id", "acc", "p")), ["question_id"], "acc", "p")
    return rounded(
        a.agg(
            F.avg("auroc").alias("auroc_mean"), F.count("auroc").alias("n_questions"),
            (F.count(F.lit(1)) - F.count("auroc")).alias("n_constant"),
        ),
        "auroc_mean",
    )


# ------------------------------------------------ embeddings
@query(
    "zscore_block",
    f"""WITH {CELLS}, {ANSWERS}, {POOLED}, l AS (SELECT model_id, unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM pooled),
    s AS (SELECT i, avg(x) AS m, greatest(stddev_pop(x), 1e-9) AS sd FROM l WHERE model_id % 5 <> 0 GROUP BY 1)
    SELECT model_id, {rvec('list((x - m) / sd ORDER BY i)', 5)} AS z FROM l JOIN s USING (i) GROUP BY 1""",
)
def zscore_block(spark, sf):
    """A text block standardised by its training models."""
    z = E.zscore(pooled(spark, sf), "emb", F.col("model_id") % 5 != 0, "z")
    return rounded_vec(z.select("model_id", "z"), "z", 5)


@query(
    "centred_bits",
    f"""WITH {CELLS} SELECT model_id, question_id, round(correct - (avg(correct) FILTER (model_id % 5 <> 0) OVER (PARTITION BY question_id)), 6) AS v FROM cells""",
)
def centred_bits(spark, sf):
    c = T.cells(spark, sf)
    train = T.models(spark, sf).filter(F.col("model_id") % 5 != 0)
    return rounded(E.center_bits(c, train), "v")


def bits(spark, sf, block=None, cells=None):
    c = T.cells(spark, sf) if cells is None else cells
    if block is not None:
        c = c.join(blocks(spark, sf).filter(F.col("block").isin(*block)), "question_id", "left_semi")
    return E.center_bits(c)


@query("bits_pca")
def bits_pca(spark, sf):
    """Four leading components of the centred bits (checked against a dense solver in the tests)."""
    scores, _, _ = E.bits_pca(E.cut_lineage(bits(spark, sf)), 4)
    return rounded_vec(scores, "vec")


def train_models(spark, sf):
    return P.k_folds(T.models(spark, sf), 5, 7).filter("fold <> 0").select("model_id")


def fused(spark, sf, block=None, cells=None):
    """The two-block embedding the evaluation queries use."""
    b = E.cut_lineage(bits(spark, sf, block, cells))
    text = E.cut_lineage(pooled(spark, sf, cells).select("model_id", "emb"))
    return E.pls_svd(b, text, (8, 8), train_models(spark, sf))


@query("pls_fusion")
def pls_fusion(spark, sf):
    """Bits and text projected on each other's leading directions, 8 + 8 wide."""
    return rounded_vec(fused(spark, sf), "vec", 5)


@query(
    "cross_covariance",
    f"""WITH {CELLS}, {ANSWERS}, {POOLED}, c AS (SELECT model_id, question_id, correct - avg(correct) OVER (PARTITION BY question_id) AS v FROM cells),
    l AS (SELECT model_id, unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM pooled), cl AS (SELECT model_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM l),
    m AS (SELECT question_id, i, sum(v * x) AS s FROM c JOIN cl USING (model_id) GROUP BY 1, 2)
    SELECT question_id, round(sqrt(sum(s * s)), 6) AS norm, {rvec('list(s ORDER BY i)', 5)} AS vec FROM m GROUP BY 1""",
)
def cross_covariance(spark, sf):
    """Question by text-dimension cross-covariance of bits and centred text."""
    text = pooled(spark, sf)
    mean = E.column_stats(text, "emb").select("mean").scalar()
    centred = text.withColumn("mu", mean).select("model_id", F.zip_with("emb", "mu", lambda x, m: x - m).alias("vec"))
    c = E.project(bits(spark, sf), centred, by="model_id", to="question_id")
    return rounded_vec(c.select("question_id", F.round(V.norm("vec"), 6).alias("norm"), "vec"), "vec", 5)


@query("channel_pca")
def channel_pca(spark, sf):
    b = E.cut_lineage(bits(spark, sf))
    return rounded_vec(E.channel_pca(b, pooled(spark, sf), 4, train_models(spark, sf)), "vec", 5)


@query("fold_in")
def fold_in(spark, sf):
    """Held-out models placed by ridge on frozen loadings of the training models."""
    b = E.cut_lineage(bits(spark, sf))
    tr = train_models(spark, sf)
    _, _, load = E.bits_pca(E.cut_lineage(b.join(tr, "model_id", "left_semi")), 4)
    return rounded_vec(E.fold_in_ridge(b.join(tr, "model_id", "left_anti"), load, 4), "vec")


@query("random_fingerprint")
def random_fingerprint(spark, sf):
    """Stacked probe answers under one random projection; the probes are a seeded sample of questions."""
    q = T.questions(spark, sf).withColumn("h", keyed_hash("7", "probe", F.col("question_id"))).orderBy("h").limit(600)
    return rounded_vec(E.random_fingerprint(answers(spark, sf), q, 16, DIM, 7), "vec", 5)


@query("hashed_text")
def hashed_text(spark, sf):
    """Hashed word and bigram embedding of every whole document."""
    out = E.hashed_text(T.documents(spark, sf).select("doc_id", "text"), "text", 32)
    return rounded_vec(out.select("doc_id", "emb"), "emb", 4)


@query("effective_rank")
def effective_rank(spark, sf):
    """Components that carry 95% of the variance of the pooled text block."""
    text = E.cut_lineage(pooled(spark, sf).select("model_id", "emb"))
    k = E.components_for_share(text, "emb")
    return text.agg(F.count(F.lit(1)).alias("n_models")).withColumn("pca95", F.lit(k))


@query(
    "fixed_table",
    f"""WITH {MODELS} SELECT model_id, round(coalesce(params_b, 0) / 1000.0::DOUBLE, 6) AS x0, is_chat::DOUBLE AS x1 FROM models""",
)
def fixed_table(spark, sf):
    """A given per-model table used as the embedding."""
    return T.models(spark, sf).select(
        "model_id", F.round(F.coalesce("params_b", F.lit(0.0)) / 1000.0, 6).alias("x0"), F.col("is_chat").cast("double").alias("x1")
    )


@query(
    "shuffled_text_control",
    f"""WITH {CELLS}, {MODELS}, {FOLDS}, {ANSWERS}, {POOLED}, s AS (SELECT model_id, CASE WHEN fold = 0 THEN 'test' ELSE 'train' END AS side FROM folds),
    p AS (SELECT *, count(*) OVER (PARTITION BY side) AS n, first_value(model_id) OVER w AS head, lead(model_id) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY side ORDER BY {h("'7'", "'derange'", 'model_id')}, model_id))
    SELECT p.model_id, side, {rvec('emb')} AS emb FROM p JOIN pooled ON pooled.model_id = coalesce(nxt, head) WHERE n > 1""",
)
def shuffled_text_control(spark, sf):
    """Control arm: every model wears the text block of another model of its side."""
    sides = P.split(P.k_folds(T.models(spark, sf), 5, 7), 0)
    d = P.derangement(sides, "side", "model_id", 7)
    text = pooled(spark, sf).select(F.col("model_id").alias("other"), "emb")
    return rounded_vec(d.join(text, "other").select("model_id", "side", "emb"), "emb")


@query(
    "probe_alignment",
    f"""WITH {CELLS}, {MODELS}, {ANSWERS}, pr AS (SELECT unnest(range(8))::INT AS probe, model_id FROM models),
    a AS (SELECT model_id, ({h("'0'", "'slot'", 'question_id')} % 8)::INT AS probe, min(question_id) AS question_id FROM cells GROUP BY 1, 2)
    SELECT pr.model_id, pr.probe, (x.emb IS NOT NULL)::INT AS mask, {rvec('coalesce(x.emb, list_transform(range(64), lambda i: 0.0::DOUBLE))')} AS emb
    FROM pr LEFT JOIN a USING (model_id, probe) LEFT JOIN answers x ON x.model_id = a.model_id AND x.question_id = a.question_id""",
)
def probe_alignment(spark, sf):
    """Eight probe slots per model, zero-filled where a model has no answer in the slot."""
    slot = (keyed_hash("0", "slot", F.col("question_id")) % 8).cast("int")
    first = T.cells(spark, sf).groupBy("model_id", slot.alias("probe")).agg(F.min("question_id").alias("question_id"))
    got = first.join(answers(spark, sf), ["model_id", "question_id"]).select("model_id", "probe", "emb")
    slots = T.models(spark, sf).select("model_id", draw_index(0, 7).alias("probe"))
    zero = F.array_repeat(F.lit(0.0).cast("float"), DIM)
    out = slots.join(got, ["model_id", "probe"], "left").select(
        "model_id", "probe", F.col("emb").isNotNull().cast("int").alias("mask"), F.coalesce("emb", zero).alias("emb")
    )
    return rounded_vec(out, "emb")
