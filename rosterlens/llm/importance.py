"""Quality by importance resampling with hashed n-gram models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm import words as W

#: Buckets of the hashed unigrams and bigrams, and what each has before any count.
BUCKETS, PRIOR = 20_000, 1.0
#: Share of the target documents that the query's sample size leaves room for, of log weight per feature.
REACH = 0.999

#: Labelled rows that the target model is fitted on at most.
TARGET_ROWS = 1_000_000

_TOKENS = regex.compile(rb"[\w\x80-\xff]+|[^\w\s\x80-\xff]+").findall


def features(text: bytes | None, cache: W.WordHashes, buckets: int) -> np.ndarray:
    """Buckets of a text's tokens (lower-case words, runs of punctuation) and neighbouring pairs."""
    h = W.hashed(_TOKENS((text or b"").lower()), cache)
    return (np.concatenate([W.gram_hashes(h, 1), W.gram_hashes(h, 2)]) % np.uint64(buckets)).astype(np.int64)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = W.WordHashes(), np.zeros((2, buckets), np.int64)
        for batch in W.pieces(batches, "text"):
            wanted = batch.column("target").to_pylist()
            for text, target in zip(W.text_bytes(batch.column("text")), wanted, strict=True):
                own = np.bincount(features(text, cache, buckets), minlength=buckets)
                counts[0] += own
                if target:
                    counts[1] += own
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], ["bucket", "raw", "target"]
        )

    return run


def bounded_target(ids: DataFrame, bound: int = TARGET_ROWS) -> DataFrame:
    """Distinct ``ids(doc_id)``; above ``bound``, about that many of them by a hash. So it can be broadcast."""
    ids = ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    n = ids.count()
    return ids if n <= bound else ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < bound)


def log_ratios(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p_target / p_raw of every bucket, from ``docs(text, target)``: raw is all rows, target those marked.

    Each task sends its counts of at most ``buckets`` buckets, and that many sums come to the driver, for any
    input. Without target rows both models are the prior's and raw's, so no document is preferred
    by what it doesn't share; without any row all ratios are 0.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.coalesce("target", F.lit(False)).alias("target"))
    counts = rows.mapInArrow(_count(buckets), "bucket long, raw long, target long").groupBy("bucket")
    raw, target = np.full(buckets, PRIOR), np.full(buckets, PRIOR)
    for row in counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    if target.sum() == buckets * PRIOR:
        return np.zeros(buckets)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def weighted(docs: DataFrame, ratios: np.ndarray, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with n_features and log_weight of the whole text.

    Null and empty texts have no feature and a weight of 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = W.WordHashes()
        for batch in W.pieces(batches, "text"):
            found = [features(t, cache, len(ratios)) for t in W.text_bytes(batch.column("text"))]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([round(float(ratios[f].sum()), 6) for f in found], pa.float64()),
                ],
                [*names, "n_features", "log_weight"],
            )

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(
        run, W.with_columns(docs, keep, "n_features long, log_weight double")
    )


def gumbel(seed: int, *keys: str) -> F.Column:
    """A Gumbel draw that follows from the seed and the keys alone, so a lost task draws it again."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 12)
    uniform = (bits + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def ordered(column: F.Column) -> F.Column:
    """A long that sorts as the double does."""
    return F.round(F.least(F.greatest(column, F.lit(-9.0e11)), F.lit(9.0e11)) * 1e6).cast("long") + F.lit(1 << 60)


def cut_at(ranks: DataFrame, k: int) -> int | None:
    """The ``k``-th largest of ``ranks(rank)``, a non-negative long; None if there are fewer rows.

    Digit by digit from the top: each pass counts the values of one 13-bit digit under the digits found so far.
    So at most 8192 counts come to the driver, and no sort of all rows is needed.
    """
    found, width = 0, 13
    for shift in range(52, -1, -width):  # a rank is under 2 ** 61 and, with ``ordered``, over 2 ** 59
        under = ranks.where(F.shiftright("rank", shift + width) == found) if found else ranks
        counts = under.groupBy((F.shiftright("rank", shift) % (1 << width)).alias("digit")).count().collect()
        for row in sorted(counts, key=lambda r: -r.digit):
            if row["count"] >= k:
                found = (found << width) | row.digit
                break
            k -= row["count"]
        else:
            return None
    return found


def resampled(weights: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``weights(doc_id, log_weight, ...)`` with key = log_weight + Gumbel draw, and kept: the ``k`` largest.

    That draws ``k`` rows without return, in proportion to their weights. Rows with one doc_id share a draw.
    Rows equal to the last key kept are all kept, so the result doesn't depend on their order. A ``k`` of
    0 keeps none. Where ``weights`` have n_features, rows with none (null and empty texts) are not drawn and
    take no place: kept is false for them.
    """
    able = F.coalesce(F.col("n_features") > 0, F.lit(False)) if "n_features" in weights.columns else F.lit(True)
    keyed = weights.withColumn("key", F.round(F.col("log_weight") + gumbel(seed, "doc_id"), 6)).withColumn("rank", ordered(F.col("key")))
    if k <= 0:
        return keyed.withColumn("kept", F.lit(False)).drop("rank")
    cut = cut_at(keyed.where(able).select("rank"), k)
    return keyed.withColumn("kept", able if cut is None else able & (F.col("rank") >= cut)).drop("rank")


def room(weights: DataFrame, reach: float = REACH) -> int:
    """How many of ``weights(target, n_features, log_weight)`` are as good as the ``reach`` best of the target.

    Goodness is the log weight per feature, which doesn't grow with length. The limit is the exact rank among
    target rows, and all rows are counted against it.
    """
    goods = weights.where("n_features > 0").select(
        ordered(F.col("log_weight") / F.col("n_features")).alias("rank"), F.coalesce("target", F.lit(False)).alias("target")
    )
    n = goods.where("target").count()
    cut = cut_at(goods.where("target").select("rank"), int(np.ceil(reach * n))) if n else None
    return goods.count() if cut is None else goods.where(F.col("rank") >= cut).count()
