import random

import pytest
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

SCHEMA = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        # names that operators use for columns of their own
        StructField("score", DoubleType()),
        StructField("kept", StringType()),
        StructField("n", LongType()),
        StructField("row", StringType()),
        StructField("rep", LongType()),
    ]
)
WORDS = "the of and red blue green stone river walks over under near house tree cloud seven quickly".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def odd_rows():
    base = prose(1, 120)
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "12 34 !!"), (5, "one two"), (6, "one two"), (7, base), (8, base), (8, base),
        (9, base.replace("red", "rod", 1)), (10, "Ünï Σίσυφος İstanbul 中文字 👍 <|endoftext|> it's"), (11, prose(2, 30_000)),
        (12, prose(3, 90)), (12, prose(4, 90)), (13, prose(4, 90) + " tail"), (None, base), (None, None), (14, "a\0b c"),
        (15, "spam " * 4000), (16, "x" * 100_000),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), 0.5, "k", 1, "r", 2) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def spec(spark):
    from rosterlens.llm import queries

    return queries.tokenizer(spark)
