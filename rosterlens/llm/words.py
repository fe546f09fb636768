"""Words of a text and their 64-bit hashes, for tasks that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Odd multipliers of the rolling combination of word hashes, and of the final mix.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """word -> 64-bit hash; forgets all it holds at ``limit`` words, so its memory is bounded."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def lowered_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z in lower case."""
    return text.lower().split()


def hashed(words: list[bytes], cache: WordHashes) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbouring words, given the words' hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    x = np.full(m, n, np.uint64)
    for i in range(n):
        x = (x ^ h[i : i + m]) * STEP
        x ^= x >> np.uint64(32)
    return mixed(x)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; no decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def lean_batches(spark: SparkSession) -> None:
    """Batches of at most 8 MB between Spark and Python, so that long texts don't fill a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def pieces(batches: Iterator[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(lengths, dtype=np.int64) // size)) + 1
        edges = [0, *cut.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
    pa.default_memory_pool().release_unused()


def with_columns(df: DataFrame, keep: list[str], more: str) -> StructType:
    """The schema of the columns ``keep`` of ``df``, then ``more``."""
    return StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(more)])


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list<int64> column from one uint64 array per row."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_DRAWN = np.random.Generator(np.random.PCG64(0x6C6D))
_OF_BYTE = _DRAWN.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_OF_PLACE = _DRAWN.integers(0, 1 << 63, 1 << 16, np.uint64) * np.uint64(2) + np.uint64(1)


def spans(octets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text of bytes begin and end."""
    edges = np.flatnonzero(np.diff(_WHITE[octets], prepend=True, append=True))
    return edges[::2], edges[1::2]


def span_hashes(octets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a random factor for each byte at each place, summed.

    A word of more bytes than there are places is hashed by itself, so that bytes far apart are not mistaken
    for each other.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    firsts = np.cumsum(lengths) - lengths
    inside = np.flatnonzero(~_WHITE[octets])
    place = np.arange(len(inside)) - np.repeat(firsts, lengths)
    longer = np.flatnonzero(lengths > len(_OF_PLACE))
    if len(longer):
        place %= len(_OF_PLACE)
    out = mixed(np.add.reduceat(_OF_BYTE[octets[inside]] * _OF_PLACE[place], firsts) + lengths.astype(np.uint64))
    for i in longer.tolist():
        out[i] = xxhash.xxh3_64_intdigest(octets[starts[i] : ends[i]].tobytes())
    return out
