"""Vector arithmetic on array columns, inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column | str) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a: Column | str, floor: float = 1e-9) -> Column:
    """The vector at unit length. The length is bound once, not computed again per element."""
    a = F.col(a) if isinstance(a, str) else a
    length = F.array(F.greatest(norm(a), F.lit(floor)))
    return F.get(F.transform(length, lambda n: F.transform(a, lambda x: x.cast("double") / n)), F.lit(0))


def dims(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """Long form (keep..., dim, value) of an array column."""
    return df.select(*keep, F.posexplode(vector).alias("dim", "value"))


def gather(df: DataFrame, keys: list[str], dim: str, value: str, out: str) -> DataFrame:
    """Array column back from its long form; one array per key, as long as the vector."""
    return df.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(dim), F.col(value)))), lambda s: s[value]).alias(out)
    )
