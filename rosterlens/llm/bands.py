"""Quality rules from counts and from zstandard ratios in bands by length."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm import words as W

#: From how many bytes on, and the lowest and highest compressed share of a whole document. Short texts
#: carry the frame's own bytes, and long ones repeat their words, so both limits fall with length.
WHOLE = (
    (0, 0.0, 9.0),
    (64, 0.35, 1.40),
    (128, 0.35, 1.15),
    (256, 0.38, 0.95),
    (512, 0.40, 0.85),
    (1024, 0.38, 0.78),
    (4096, 0.35, 0.74),
    (16384, 0.33, 0.72),
    (65536, 0.30, 0.70),
)
#: Bytes of a chunk, its limits, and the share of chunks that may be outside them.
CHUNK, CHUNK_LOW, CHUNK_HIGH, CHUNK_SHARE = 2048, 0.30, 0.80, 0.25
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
#: The base rules: words at least; words in repeated windows, in hundredths of all, at most.
MIN_WORDS, MAX_REPEAT = 50, 50

_STARTS = [row[0] for row in WHOLE]


def chunks(text: bytes, size: int = CHUNK) -> list[bytes]:
    """Pieces of ``size`` bytes; a last piece of under half of that stays with the one before."""
    n = max(1, (len(text) + size // 2) // size)
    return [text[i * size : (i + 1) * size if i < n - 1 else None] for i in range(n)]


def compression(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Compressed share of the whole, share of chunks outside their limits, and whether both are in band."""
    if not text:
        return 0.0, 0.0, False
    whole = len(packer.compress(text)) / len(text)
    outside = 0.0
    if len(text) >= CHUNK:
        shares = [len(packer.compress(c)) / len(c) for c in chunks(text)]
        outside = sum(not CHUNK_LOW <= s <= CHUNK_HIGH for s in shares) / len(shares)
    _, low, high = WHOLE[bisect_right(_STARTS, len(text)) - 1]
    return whole, outside, low <= whole <= high and outside <= CHUNK_SHARE


def repeated_words(h: np.ndarray) -> int:
    """Words that stand in a 3-word window found twice or more."""
    windows = W.gram_hashes(h, 3)
    if not len(windows):
        return 0
    _, at, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(len(h), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def measured(text: bytes | None, cache: W.WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or b""
    words = text.split()
    octets = np.frombuffer(text, np.uint8)
    starts = int(np.count_nonzero((octets & 0xC0) != 0x80))
    white = len(text) - sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        starts - white,
        sum(text.count(c) for c in (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS)))),
        len(lines) - len(set(lines)),
        repeated_words(W.hashed(words, cache)),
    )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache, packer = W.WordHashes(), zstandard.ZstdCompressor(level=LEVEL)
    for batch in W.pieces(batches, "text"):
        texts = W.text_bytes(batch.column("text"))
        counts = np.array([measured(t, cache) for t in texts], np.int64)
        packed = [compression(t or b"", packer) for t in texts]
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT * counts[:, 0])
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in names],
                *[pa.array(counts[:, i]) for i in range(5)],
                pa.array([p[0] for p in packed], pa.float64()),
                pa.array([p[1] for p in packed], pa.float64()),
                pa.array(failed),
                pa.array(~failed & np.array([p[2] for p in packed], bool)),
            ],
            [*names, *_MEASURES],
        )


_MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "whole_ratio", "chunks_outside", "base_failed", "kept",
)


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with its counts, ratios and verdict, one row per row.

    ``kept`` is false for documents that fail the base rules; of the others, for those whose compressed share
    is outside the band of their length (too low: repetition, too high: noise), or of whose chunks
    too many are outside theirs. Null and empty texts have counts and ratios of 0 and fail. Further
    columns are ignored. A document is judged alone, so nothing is shuffled.
    """
    kinds = ["long"] * 5 + ["double"] * 2 + ["boolean"] * 2
    schema = W.with_columns(docs, keep, ", ".join(f"{n} {k}" for n, k in zip(_MEASURES, kinds, strict=True)))
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(_run, schema)
