"""Grading of single answers."""

import pytest
from pyspark.sql import functions as F

from rosterlens.functions import extract as X
from rosterlens.functions import grade as G

CASES = [
    # adapter, bench, text, gold, right
    ("mcq", "mmlu", "The answer is (B).", "B", True),
    ("mcq", "mmlu", "\\boxed{B}", "B", True),
    ("mcq", "mmlu", "\\boxed{\\text{b}}", "B", True),
    ("mcq", "mmlu", "The answer is (C).", "B", False),
    ("mcq", "mmlu", "I would rather not say.", "B", False),
    ("mcq", "mmlu", "maybe (A), no, (B)\nthen", "B", True),
    ("mcq_think", "mmlu", "<think>(A)</think>\nAnswer: B<|eot|>", "B", True),
    ("mcq_think", "mmlu", "<think>the answer is (B)</think>\n", "B", True),
    ("free", "asdiv", "so \\boxed{15}", "15", True),
    ("free", "asdiv", "\\boxed{16}", "15", False),
    ("free", "asdiv", "The final answer is $9$. Bye", "9 (apples)", True),
    ("free", "asdiv", "text\n204.\n", "204", True),
    ("free", "asdiv", "\\boxed{\\frac{1}{2}}", "\\frac{1}{2}", True),
    ("free", "asdiv", "1,200", "1200.0", True),
    ("free", "asdiv", "", "x", False),
    ("code", "mbpp", "```python\nx\n```", "x", False),
    ("legacy", "gsm8k", "first 3, the answer is $1,234", "1234", True),
    ("legacy", "gsm8k", "#### 42.0", "42", True),
    ("legacy", "math", "\\boxed{ \\dfrac{1}{2} }", "\\frac{1}{2}", True),
    ("legacy", "math", "The answer is $7$.", "7", True),
    ("legacy", "gpqa", "the Answer: (c)", "C", True),
    ("legacy", "bbh", "So the answer is (D).", "D", True),
    ("legacy", "bbh", "final\nThe answer is yes.", "Yes", True),
]


@pytest.fixture(scope="module")
def graded(spark):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], "i int, adapter string, bench string, t string, gold string")
    return {r["i"]: r["graded"] for r in G.grade_responses(df, "adapter", "bench", "t", "gold").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_grade(graded, i):
    assert graded[i] is CASES[i][4], CASES[i]


def test_boxed_is_balanced(spark):
    texts = ["\\boxed{a{b}c} d", "\\boxed{a} then \\boxed  {b{c}}", "\\boxed{open {x}", "none", "\\boxed no brace", "\\boxed{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(X.boxed(F.col("t"))).collect()]
    assert got == ["a{b}c", "b{c}", None, None, None, ""]


def test_option_letters_stop_at_the_number_of_choices(spark):
    df = spark.createDataFrame([("The answer is (D).", 3), ("The answer is (C).", 3)], "t string, n int")
    df, t = X.stage(df, F.col("t"), "t")
    assert [r[0] for r in df.select(X.mcq(t, F.col("n"))).collect()] == [None, "C"]
