"""The answer-log roles read off the given tables.

draws       one lineitem row is one graded draw of (model = supplier, question = brand|type)
cells       draws folded to (model, question)
responses   the text of a draw
models      supplier with family, size, chat flag
vectors     the embeddings table, as answer or question vectors
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.functions.draws import keyed_hash
from rosterlens.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def question_id() -> Column:
    return F.concat_ws("|", F.col("p_brand"), F.col("p_type"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions(question_id, bench)."""
    return (
        table(spark, sf_dir, "part")
        .select(question_id().alias("question_id"), F.col("p_type").alias("bench"))
        .distinct()
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """models(model_id, name, family, params_b, vram_gb, is_chat); a size of 0 or less is missing."""
    size = F.when(F.col("s_acctbal") > 0, F.col("s_acctbal"))
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("model_id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("family"),
        size.alias("params_b"),
        (size / F.lit(100.0)).alias("vram_gb"),
        (keyed_hash("0", "chat", F.col("s_suppkey")) % 2).cast("int").alias("is_chat"),
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """draws(model_id, question_id, bench, correct, order_id, line_no, part_id)."""
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("model_id"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        (F.col("l_quantity") > 25).cast("int").alias("correct"),
    )
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part_id"), question_id().alias("question_id"), F.col("p_type").alias("bench")
    )
    return line.join(part, "part_id")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from rosterlens.operators.cells import fold_cells

    return fold_cells(draws(spark, sf_dir))


#: Answer wordings of the response view, by line number modulo 6. {L} is an option letter,
#: {N} a number. The oracle SQL builds the same strings.
WORDINGS = (
    "Let us work through it.\nThe answer is ({L}).",
    "So we obtain \\boxed{\\text{{L}}}.",
    "<think>maybe (A) or 7</think>\nFinal answer: {L}<|im_end|>",
    "I cannot be sure, but the total is {N},000.50.\nThe final answer is {N}. Done",
    "#### {N}\n",
    "Reasoning...\n\n({L})",
)


def response_text(line_no: Column, letter: Column, number: Column) -> Column:
    """The wording of a draw with its letter and number filled in."""
    out = F.lit(None).cast("string")
    for i, wording in enumerate(WORDINGS):
        filled = F.replace(
            F.replace(F.lit(wording), F.lit("{L}"), letter), F.lit("{N}"), number
        )
        out = F.when(line_no % len(WORDINGS) == i, filled).otherwise(out)
    return out


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """responses(order_id, line_no, model_id, part_id, prediction, gold_letter, gold_number)."""
    letter = F.char(F.lit(65) + F.col("l_partkey") % 4)
    number = F.col("l_partkey").cast("string")
    keys = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    return spread(keys).select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("model_id"),
        F.col("l_partkey").alias("part_id"),
        response_text(F.col("l_linenumber"), letter, number).alias("prediction"),
        F.char(F.lit(65) + F.col("l_suppkey") % 4).alias("gold_letter"),
        F.col("l_suppkey").cast("string").alias("gold_number"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents(doc_id, text, lang, source), spread over the cores for work on whole texts."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors(vec_id, emb, label)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("emb"), "label")
