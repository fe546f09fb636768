"""How a respondent answers: twelve style traits from the answer text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.functions.ranks import EPS

# Wordings that count as a hedge, a refusal, the first person.
HEDGE = r"(?i)\b(i think|probably|perhaps|maybe|it seems|not sure|might be|if i am not mistaken)\b"
REFUSAL = r"(?i)\b(i cannot|i can't|i am unable|i'm unable|i won't|as an ai|i'm sorry, but)\b"
FIRST_PERSON = r"\b(I|I'm|my|me|My)\b"
LIST_LINE = r"(?m)^\s*([-*]|\d+[.)])\s+\S"
TOKEN = r"[^\t-\r\x1c-\x1f\x{85}\p{Z}]+"
CODE_MARK = "```"
SENTENCE_END = r"[.!?)}\"'`]\s*$"

TRAITS = (
    "log_n_tok", "z_n_tok", "z_n_char", "hedge_rate", "refusal_rate", "truncation_rate",
    "list_rate", "boxed_rate", "code_rate", "first_person_rate", "newline_rate", "log_n_char",
)


def answer_flags(answers: DataFrame) -> DataFrame:
    """One row per answer: lengths and 0/1 style flags. answers(model_id, question_id, text)."""
    t = F.col("text")
    return answers.select(
        "model_id",
        "question_id",
        F.regexp_count(t, F.lit(TOKEN)).cast("double").alias("n_tok"),
        F.length(t).cast("double").alias("n_char"),
        F.regexp(t, F.lit(HEDGE)).cast("double").alias("hedge"),
        F.regexp(t, F.lit(REFUSAL)).cast("double").alias("refusal"),
        (~F.regexp(t, F.lit(SENTENCE_END))).cast("double").alias("truncated"),
        F.regexp(t, F.lit(LIST_LINE)).cast("double").alias("listed"),
        F.contains(t, F.lit("\\boxed")).cast("double").alias("boxed"),
        F.contains(t, F.lit(CODE_MARK)).cast("double").alias("code"),
        F.regexp(t, F.lit(FIRST_PERSON)).cast("double").alias("first_person"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("double").alias("newlines"),
    )


def text_traits(answers: DataFrame) -> DataFrame:
    """traits(model_id, n_answers, <twelve traits>).

    The two standardised lengths are z-scores inside each question. The question's mean and
    spread come from a partial aggregate and are joined back, so a question that holds most of
    the answers is never gathered into one window.
    """
    flags = answer_flags(answers)
    per_q = flags.groupBy("question_id").agg(
        *[fn(c).alias(f"{p}_{c}") for c in ("n_tok", "n_char") for p, fn in (("m", F.avg), ("s", F.stddev_pop))]
    )
    z = flags.join(per_q, "question_id")

    def score(c: str):
        return (F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"s_{c}"), F.lit(EPS))

    return z.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("n_answers"),
        F.avg(F.ln(F.lit(1.0) + F.col("n_tok"))).alias("log_n_tok"),
        F.avg(F.ln(F.lit(1.0) + F.col("n_char"))).alias("log_n_char"),
        F.avg(score("n_tok")).alias("z_n_tok"),
        F.avg(score("n_char")).alias("z_n_char"),
        F.avg("hedge").alias("hedge_rate"),
        F.avg("refusal").alias("refusal_rate"),
        F.avg("truncated").alias("truncation_rate"),
        F.avg("listed").alias("list_rate"),
        F.avg("boxed").alias("boxed_rate"),
        F.avg("code").alias("code_rate"),
        F.avg("first_person").alias("first_person_rate"),
        F.avg(F.col("newlines") / F.greatest(F.col("n_char"), F.lit(1.0))).alias("newline_rate"),
    )


def long_traits(traits: DataFrame, models: DataFrame) -> DataFrame:
    """(model_id, trait, value, covered) on a model axis: an unlisted model has NULL values."""
    wide = models.select("model_id").join(traits, "model_id", "left")
    covered = F.col("n_answers").isNotNull().cast("int").alias("covered")
    return wide.withColumn("covered", covered).unpivot(
        ["model_id", "covered"], list(TRAITS), "trait", "value"
    )
