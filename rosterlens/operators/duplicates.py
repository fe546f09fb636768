"""Models whose correctness bits nearly agree, without comparing every pair."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per packed word.
WORD = 60

#: Members above which a band bucket is split by a second band.
HOT = 64


def pack_bits(bits: DataFrame, n_bits: int) -> DataFrame:
    """(model_id, words array<bigint>) of bits(model_id, ix, bit); a missing bit is 0."""
    n_words = math.ceil(n_bits / WORD)
    words = [
        F.sum(
            F.when((F.col("bit") == 1) & (F.floor(F.col("ix") / WORD) == w), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("ix") % WORD).cast("int"))).otherwise(0)
        )
        for w in range(n_words)
    ]
    return bits.groupBy("model_id").agg(F.array(*words).alias("words"))


def bit_text(words: Column, n_bits: int) -> Column:
    """The packed bits as a string of 0 and 1, padding left out."""
    widths = [min(WORD, n_bits - w * WORD) for w in range(math.ceil(n_bits / WORD))]
    return F.concat(*[F.lpad(F.bin(F.get(words, F.lit(w))), n, "0") for w, n in enumerate(widths)])


def _bands(text: Column, n: Column | int, bands: int) -> Column:
    """array<struct<band, bits>>: the text cut into ``bands`` nearly equal pieces."""
    n = n if isinstance(n, Column) else F.lit(n)

    def piece(i: Column) -> Column:
        lo, hi = F.floor(n * i / bands).cast("int"), F.floor(n * (i + 1) / bands).cast("int")
        return F.struct(i.alias("band"), F.substr(text, lo + 1, hi - lo).alias("bits"))

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), piece)


def fold_copies(packed: DataFrame) -> DataFrame:
    """(words, rep, n): identical rows folded onto the smallest id."""
    return packed.groupBy("words").agg(F.min("model_id").alias("rep"), F.count(F.lit(1)).alias("n"))


def classes(packed: DataFrame) -> DataFrame:
    """(model_id, rep): which representative stands for a model."""
    return packed.join(fold_copies(packed), "words").select("model_id", "rep")


def near_duplicates(packed: DataFrame, n_bits: int, threshold: float) -> DataFrame:
    """(model_a, model_b, agreement, n_a, n_b) between representatives of identical rows.

    Two rows that agree on a share ``threshold`` of the bits differ in at most t of them, so of
    t + 1 bands at least one is equal (pigeonhole): equality of a band is an exact candidate
    filter. In a bucket with many members the other bits are cut into t + 1 bands again, because
    a pair differs in at most t of those too. Identical rows are folded first, so copies never
    pair up; a representative stands for all its copies.
    """
    t = math.floor((1 - threshold) * n_bits + 1e-9)
    bands = min(t + 1, n_bits)
    rows = fold_copies(packed).withColumn("text", bit_text(F.col("words"), n_bits))
    first = rows.withColumn("k", F.explode(_bands(F.col("text"), n_bits, bands))).select(
        "rep", "n", "words", "text", "k.band", "k.bits"
    )
    size = first.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    keyed = first.join(size, ["band", "bits"])
    lo = F.floor(F.lit(n_bits) * F.col("band") / bands).cast("int")
    width = F.length("bits")
    rest = F.concat(F.substr("text", F.lit(1), lo), F.substr(F.col("text"), lo + width + 1))
    again = _bands(rest, F.lit(n_bits) - width, bands)
    whole = F.array(F.struct(F.lit(-1).alias("band"), F.lit("").alias("bits")))
    ready = keyed.withColumn(
        "k2", F.explode(F.when((F.col("members") > HOT) & (n_bits - width >= bands), again).otherwise(whole))
    ).select("rep", "n", "words", "band", "bits", F.col("k2.band").alias("band2"), F.col("k2.bits").alias("bits2"))
    a, b = ready.alias("a"), ready.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("band", "bits", "band2", "bits2")]
    pairs = a.join(b, [*same, F.col("a.rep") < F.col("b.rep")])
    differ = F.aggregate(
        F.zip_with("a.words", "b.words", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    return (
        pairs.select(
            F.col("a.rep").alias("model_a"),
            F.col("b.rep").alias("model_b"),
            (1 - differ / F.lit(float(n_bits))).alias("agreement"),
            F.col("a.n").alias("n_a"),
            F.col("b.n").alias("n_b"),
        )
        .filter(F.col("agreement") >= threshold - 1e-12)
        .distinct()
    )
