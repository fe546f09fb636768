"""Random draws as keyed hashes.

A draw is a function of (seed, purpose, key), so it does not depend on partitioning or on
which executor runs it, and a lost task redraws the same values. The distributions are
those of the usual generators; the individual draws are not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash range: 15 hex digits.
HASH_SPAN = 2**60

#: Buckets a hash order is split into, so that no task sorts a whole table.
ORDER_BUCKETS = 256


def _as_col(x: Column | str | int) -> Column:
    return x if isinstance(x, Column) else F.lit(str(x))


def keyed_hash(*parts: Column | str | int) -> Column:
    """60-bit integer hash of the parts joined by ``|``."""
    text = F.concat_ws("|", *[_as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def keyed_hash_sql(*parts: str) -> str:
    """The same hash in DuckDB SQL; string literals must arrive quoted."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT"


def uniform(*parts: Column | str | int) -> Column:
    """Uniform on [0, 1)."""
    return keyed_hash(*parts) / F.lit(float(HASH_SPAN))


def normal(*parts: Column | str | int) -> Column:
    """Standard normal by Box-Muller on two hashed uniforms."""
    u1 = (keyed_hash(*parts, "u1") + F.lit(1)) / F.lit(float(HASH_SPAN + 1))
    u2 = uniform(*parts, "u2")
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0) * F.pi() * u2)


def normal_sql(*parts: str) -> str:
    u1 = f"(({keyed_hash_sql(*parts, chr(39) + 'u1' + chr(39))} + 1)::DOUBLE / {float(HASH_SPAN + 1)!r}::DOUBLE)"
    u2 = f"({keyed_hash_sql(*parts, chr(39) + 'u2' + chr(39))}::DOUBLE / {float(HASH_SPAN)!r}::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln({u1})) * cos(2.0::DOUBLE * pi() * {u2}))"


def hash_prefix_sum(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, weight: str, out: str
) -> DataFrame:
    """Running total of ``weight`` up to and including each row, in (``order``, ``tie``) order.

    ``order`` is a hash column. The hash range is cut into equal buckets, bucket totals are
    taken with map-side combine, and only one bucket is sorted per task.
    """
    b = "__bucket"
    cut = df.withColumn(b, F.floor(F.col(order) / F.lit(HASH_SPAN // ORDER_BUCKETS)).cast("int"))
    sizes = cut.groupBy(*keys, b).agg(F.sum(weight).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = (
        Window.partitionBy(*keys, b).orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        cut.withColumn("__run", F.sum(weight).over(inside))
        .join(offsets, [*keys, b])
        .withColumn(out, F.col("__off") + F.col("__run"))
        .drop(b, "__run", "__off")
    )


def hash_position(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, out: str = "pos"
) -> DataFrame:
    """1-based position of each row inside its key group when ordered by (``order``, ``tie``)."""
    one = df.withColumn("__one", F.lit(1).cast("bigint"))
    return hash_prefix_sum(one, keys, order, tie, "__one", out).drop("__one")


def draw_index(first: int, last: int) -> Column:
    """One row per draw number; the number of draws is a parameter of the query."""
    return F.explode(F.sequence(F.lit(first), F.lit(last)))
