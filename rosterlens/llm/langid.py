"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm import words as W

#: Dimensions of the vectors, letters of an n-gram, n-grams whose vectors a task keeps.
DIMENSIONS = 1024
LETTERS = 3
HELD = 8_192
#: Rows of one dense product; with HELD it bounds a task's memory.
ROWS = 128
#: Label of a text without letters.
UNKNOWN = "und"


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)


def letters_only(text: str) -> np.ndarray:
    """Code points in lower case, each run of other characters one space, a space at both ends.

    Empty for a text without letters.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    letter = _is_letter()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    codes = np.where(letter, codes, 32)[keep]
    return codes if len(codes) > 1 else codes[:0]


class GramVectors:
    """Vectors of n-grams: the product of the letters' random +-1 vectors, each rotated by its place.

    A letter's vector follows from its code point alone, so all tasks and runs agree on it. The n-grams
    of a batch get rows of one matrix, which is emptied when it is full; so memory is bounded for
    any alphabet.
    """

    def __init__(self, dimensions: int, letters: int, held: int = HELD):
        self.dimensions, self.letters, self.held = dimensions, letters, held
        self.symbols: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.empty((0, dimensions), np.float32)

    def symbol(self, code: int) -> np.ndarray:
        if code not in self.symbols:
            if len(self.symbols) > 20_000:
                self.symbols.clear()
            bits = np.random.Generator(np.random.PCG64([code, self.dimensions])).integers(0, 2, self.dimensions, np.int8)
            self.symbols[code] = 2 * bits - 1
        return self.symbols[code]

    def bound(self, gram: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for place in range(self.letters):  # the last letter isn't rotated
            out *= np.roll(self.symbol((gram >> 21 * place) & 0x1FFFFF), place)
        return out

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Rows of the matrix that hold these distinct n-grams, at most ``held`` of them."""
        new = [g for g in grams.tolist() if g not in self.rows]
        if len(self.rows) + len(new) > self.held:
            self.rows.clear()
            new = grams.tolist()
        if (need := len(self.rows) + len(new)) > len(self.matrix):
            grown = np.empty((min(self.held, max(need, 2 * len(self.matrix))), self.dimensions), np.float32)
            grown[: len(self.matrix)] = self.matrix
            self.matrix = grown
        for g in new:
            self.matrix[len(self.rows)] = self.bound(g)
            self.rows[g] = len(self.rows)
        return np.fromiter((self.rows[g] for g in grams.tolist()), np.int64, len(grams))


def gram_counts(codes: np.ndarray, letters: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, as code points of 21 bits each, and their counts."""
    codes = codes.astype(np.int64)
    if len(codes) < letters:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    grams = np.zeros(len(codes) - letters + 1, np.int64)
    for i in range(letters):
        grams = (grams << 21) | codes[i : i + len(grams)]
    return np.unique(grams, return_counts=True)


def bundles(texts: list[str | None], vectors: GramVectors) -> tuple[np.ndarray, np.ndarray]:
    """One unit vector per text, and which texts have a letter at all."""
    out = np.zeros((len(texts), vectors.dimensions), np.float32)
    counted = [gram_counts(letters_only(t or ""), vectors.letters) for t in texts]
    for start in range(0, len(texts), ROWS):
        part = counted[start : start + ROWS]
        all_grams = np.unique(np.concatenate([g for g, _ in part]))
        for lo in range(0, len(all_grams), vectors.held):
            grams = all_grams[lo : lo + vectors.held]
            at = vectors.of(grams)
            dense = np.zeros((len(part), int(at.max()) + 1), np.float32)
            for i, (g, c) in enumerate(part):
                place = np.searchsorted(grams, g)
                place[place == len(grams)] = 0
                here = grams[place] == g
                dense[i, at[place[here]]] = c[here]
            out[start : start + len(part)] += dense @ vectors.matrix[: dense.shape[1]]
    norm = np.sqrt(np.einsum("ij,ij->i", out, out))[:, None]
    return out / np.maximum(norm, 1e-9), np.array([len(g) > 0 for g, _ in counted], bool)


def _learn(dimensions: int, letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums, counts = GramVectors(dimensions, letters), {}, {}
        for batch in W.pieces(batches, "text"):
            units, some = bundles(batch.column("text").to_pylist(), vectors)
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in {x for x, y in zip(langs, some, strict=True) if y}:
                rows = (langs == lang) & some
                sums[lang] = sums.get(lang, 0) + units[rows].sum(axis=0, dtype=np.float64)
                counts[lang] = counts.get(lang, 0) + int(rows.sum())
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.string()),
                pa.array([counts[x] for x in names], pa.int64()),
                pa.array([sums[x].tolist() for x in names], pa.list_(pa.float64())),
            ],
            ["lang", "n", "total"],
        )

    return run


def prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS, letters: int = LETTERS) -> dict[str, np.ndarray]:
    """lang -> unit vector, the bundle of the unit vectors of that language's texts.

    Every task sums the texts it has, so a language with most of the rows is summed in parts. What comes
    to the driver is one vector for each language, whatever the number of documents. Each sum is rounded to
    5 digits, so that the order of addition has no effect. Rows without lang or letters teach nothing.
    """
    parts = labelled.where("lang is not null and text is not null").select("lang", "text").mapInArrow(
        _learn(dimensions, letters), "lang string, n long, total array<double>"
    )
    sums = (
        parts.select("lang", F.posexplode("total").alias("place", "x"))
        .groupBy("lang", "place")
        .agg(F.sum(F.round("x", 5).cast("decimal(28,5)")).cast("double").alias("x"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("v"))
    )
    out = {}
    for row in sums.collect():
        v = np.array([e.x for e in row.v])
        out[row.lang] = (v / max(float(np.sqrt(v @ v)), 1e-9)).astype(np.float32)
    return out


def _predict(names: list[str], matrix: np.ndarray, dimensions: int, letters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = GramVectors(dimensions, letters)
        for batch in W.pieces(batches, "text"):
            units, some = bundles(batch.column("text").to_pylist(), vectors)
            if names:
                cosines = units @ matrix.T
                best = cosines.argmax(axis=1)
                score = np.clip(np.round(cosines[np.arange(len(best)), best].astype(np.float64), 5), 0, 1)
            else:
                best, score, some = np.zeros(len(some), int), np.zeros(len(some)), np.zeros(len(some), bool)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in batch.schema.names if c != "text"],
                    pa.array([names[i] if y else UNKNOWN for i, y in zip(best, some, strict=True)], pa.string()),
                    pa.array(np.where(some, score, 0.0)),
                ],
                [*[c for c in batch.schema.names if c != "text"], "lang_pred", "score"],
            )

    return run


def identify(
    docs: DataFrame, protos: dict[str, np.ndarray], keep: list[str], dimensions: int = DIMENSIONS, letters: int = LETTERS
) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score, one row per row.

    score is the cosine with the best prototype, 0 where it is negative; of equal prototypes the first by
    name wins. A null text, a text without letters, and any text where nothing was learned get ``und`` and
    0. Further columns are ignored.
    """
    names = sorted(protos)
    matrix = np.array([protos[x] for x in names], np.float32).reshape(len(names), dimensions)
    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(
        _predict(names, matrix, dimensions, letters), W.with_columns(docs, keep, "lang_pred string, score double")
    )
