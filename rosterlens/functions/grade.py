"""Normalisation of answers and the graders, as boolean columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.functions import extract as X

# Fixed tolerances.
FREE_TOLERANCE = 1e-6
GSM8K_TOLERANCE = 1e-4


def _drop(text: Column, *tokens: str) -> Column:
    for t in tokens:
        text = F.replace(text, F.lit(t), F.lit(""))
    return text


def _outer_braces(s: Column) -> Column:
    """Without one pair of braces around the whole."""
    return X.bind(s, lambda t: F.when(t.startswith("{") & t.endswith("}"), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t))


def _one_space(s: Column) -> Column:
    """Runs of whitespace as one space."""
    return F.regexp_replace(s, f"[{X.WHITESPACE}]+", " ")


def _plain(text: Column) -> Column:
    """Wrappers, sizing and spacing commands, dollars and bold marks removed."""
    s = F.replace(_drop(X.unwrap_latex(text), "\\left", "\\right", "\\!", "\\,"), F.lit("\\ "), F.lit(" "))
    return _drop(s, "$", "**")


def _unit_dropped(s: Column) -> Column:
    """Without a trailing parenthesised unit."""
    pattern = X.java(r"\s*\([^)]*\)\s*\z")
    return X.bind(s, lambda t: F.when(t.endswith(")"), X.strip(F.regexp_replace(t, pattern, ""))).otherwise(t))


def normal_free(text: Column) -> Column:
    s = X.strip(F.btrim(X.strip(_plain(text)), F.lit("\"'`")))
    s = X.strip(_outer_braces(X.strip(F.rtrim(s, F.lit(".")))))
    return _one_space(F.lower(_unit_dropped(s)))


def normal_bbh(text: Column) -> Column:
    s = F.btrim(X.strip(_plain(text)), F.lit("\"'` "))
    s = X.strip(F.rtrim(X.strip(s), F.lit(".")))
    return _one_space(F.lower(X.strip(_outer_braces(s))))


def normal_math(text: Column) -> Column:
    s = F.regexp_replace(X.strip(text), r"\\text\{[^}]*\}", "")
    s = _drop(s, "\\left", "\\right", "\\!", "\\,", "\\ ")
    s = F.replace(F.replace(s, F.lit("\\dfrac"), F.lit("\\frac")), F.lit("\\tfrac"), F.lit("\\frac"))
    s = _drop(s, " ", "$", "\\%", "%")
    return _outer_braces(F.rtrim(s, F.lit(".")))


#: What counts as a number when two answers are compared.
FLOAT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def number(text: Column) -> Column:
    """The text as a double, NULL when it is not one."""
    return X.bind(X.strip(text), lambda t: F.when(F.regexp(t, F.lit(FLOAT)), t.try_cast("double")))


def free_match(predicted: Column, gold: Column) -> Column:
    """Equal after normalisation, or equal numbers. Both sides arrive normalised."""
    near = F.abs(number(_drop(predicted, ",")) - number(_drop(gold, ","))) < FREE_TOLERANCE
    return F.coalesce((predicted == gold) | F.coalesce(near, F.lit(False)), F.lit(False))


def letter_match(predicted: Column, gold: Column) -> Column:
    return F.coalesce(predicted == F.upper(X.strip(gold)), F.lit(False))


def gsm8k_match(predicted: Column, gold: Column) -> Column:
    a, b = number(predicted), number(gold)
    return F.coalesce(
        F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) < GSM8K_TOLERANCE).otherwise(X.strip(predicted) == X.strip(gold)),
        F.lit(False),
    )


def math_match(predicted: Column, gold: Column) -> Column:
    """Equality after normalisation; symbolic equivalence is not tried."""
    want = F.when(F.contains(gold, F.lit("\\boxed")), X.boxed(gold)).otherwise(gold)
    return F.coalesce(normal_math(predicted) == normal_math(want), F.lit(False))


def bbh_match(t: X.Text, gold: Column) -> Column:
    g = X.strip(F.coalesce(gold, F.lit("")))
    return F.when(
        F.regexp(g, F.lit("^[A-Z]$")), F.coalesce(X.bbh_letter(t) == g, F.lit(False))
    ).otherwise(normal_bbh(X.bbh_free(t)) == normal_bbh(g))


def grade_responses(
    df: DataFrame, adapter: str, bench: str, text: str, gold: str, n_choices: Column | int = 26
) -> DataFrame:
    """Adds ``extracted`` and ``graded`` for every answer format in one pass over the responses.

    Special tokens go first. Code answers are extracted but never run, so they grade as
    incorrect. Instruction-following answers have their own operator and stay NULL here.
    """
    a, b, g = F.col(adapter), F.col(bench), F.col(gold)
    out, t = X.stage(df, X.strip_special_tokens(F.col(text)), "__t")
    out, tail = X.stage(out, X.after_think(t.raw), "__k", t)
    legacy = a == "legacy"

    def read_mcq(x: X.Text) -> Column:
        return X.mcq(x, n_choices)

    picked = (
        F.when(a == "mcq", read_mcq(t))
        .when(a == "mcq_think", X.think_first(read_mcq, t, tail))
        .when(a == "free", X.free(t))
        .when(a == "free_think", X.think_first(X.free, t, tail))
        .when(a == "code", X.code(t, tail))
        .when(legacy & (b == "gsm8k"), X.gsm8k(t))
        .when(legacy & (b == "math"), X.math(t))
        .when(legacy & (b == "gpqa"), X.gpqa(t))
    )
    out = out.withColumn("extracted", picked)
    e = F.col("extracted")
    is_free = F.startswith(a, F.lit("free"))
    out = out.withColumn("__pn", F.when(is_free, normal_free(e))).withColumn("__gn", F.when(is_free, normal_free(g)))
    graded = (
        F.when(a.isin("mcq", "mcq_think"), letter_match(e, g))
        .when(is_free, free_match(F.col("__pn"), F.col("__gn")))
        .when(a == "code", F.lit(False))
        .when(legacy & (b == "gsm8k"), gsm8k_match(e, g))
        .when(legacy & (b == "math"), math_match(e, g))
        .when(legacy & (b == "gpqa"), F.coalesce(e == F.upper(g), F.lit(False)))
        .when(legacy & (b == "bbh"), bbh_match(t, g))
    )
    return out.withColumn("graded", graded).select(*df.columns, "extracted", "graded")
