"""Benchmark decontamination by q-gram lemma filtering and banded alignment."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm import words as W

#: Symbols of a q-gram, and edits in hundredths of an item's length that still count as a copy.
Q, EDITS = 12, 6
#: Shared q-grams that the lemma must leave for any item; fewer edits are allowed where it would not.
LEAST = 4
#: Symbols of benchmark text that one pass over the documents holds.
PART = 8_000_000
#: Shared q-grams that are listed at a time; their counts by band are added up.
HITS = 1 << 21
#: Slots of the table that most windows fail in, as a power of two; more for larger parts.
SLOTS = 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _folding() -> np.ndarray:
    """Code point -> its lower case, or space for all but letters and digits; 0 stays."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    out[0] = 0
    return out


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits in lower case, runs of others as one space, and where in the text each was.

    A zero parts texts that were joined; no space follows a zero.
    """
    codes = _folding()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    solid = codes != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1] & (codes[:-1] != 0)
    at = np.flatnonzero(keep)
    return codes[at], at


def windows(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of Q symbols; runs across a zero hash too, but match nothing."""
    if len(codes) < Q:
        return np.empty(0, np.uint64)
    x = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint64)
    two = x[:-1] | x[1:] << np.uint64(16)
    four = two[:-2] | two[2:] << np.uint64(32)
    return (four[:-8] * _A ^ (four[4:-4] + _A) * _B) + (four[8:] ^ _B) * _A


def trimmed(codes: np.ndarray) -> np.ndarray:
    """Without a space at either end."""
    solid = np.flatnonzero(codes != 32)
    return codes[solid[0] : solid[-1] + 1] if len(solid) else codes[:0]


def spelled(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le")


def short_windows(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the ``n`` symbols from each place in ``at``."""
    out = np.full(len(at), n, np.uint64)
    for i in range(n):
        out = (out ^ codes[at + i].astype(np.uint64)) * _A
        out ^= out >> np.uint64(32)
    return out


class Items:
    """The q-grams of benchmark items, sorted, with where each stands; items with fewer than Q symbols by their spelling."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        self.codes = [trimmed(folded((t or "").replace("\0", " "))[0]) for t in texts]
        lengths = np.array([len(c) for c in self.codes], np.int64)
        #: Edits allowed: the share of the length, as far as the lemma leaves LEAST shared q-grams.
        self.budget = np.clip(np.minimum(lengths * EDITS // 100, (lengths - Q + 1 - LEAST) // Q), 0, None)
        #: A copy within k edits shares at least this many of the item's n - q + 1 windows.
        self.bound = np.maximum(lengths - Q + 1 - self.budget * Q, 1)
        grams = [windows(c) for c in self.codes]
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.grams, self.first = np.unique(flat[order], return_index=True)
        self.item, self.place = item[order], place[order]
        self.last = np.append(self.first[1:], len(flat))
        self.short: dict[int, dict[str, list[int]]] = {}  # by length, then spelling
        for i, c in enumerate(self.codes):
            if 0 < len(c) < Q:
                self.short.setdefault(len(c), {}).setdefault(spelled(c), []).append(i)
        self.keys = {n: np.unique(np.concatenate([short_windows(self.codes[own[0]], np.zeros(1, np.int64), n) for own in held.values()])) for n, held in self.short.items()}
        self.bits = np.uint64(64 - max(SLOTS, int(np.ceil(np.log2(max(1, len(self.grams)) * 16)))))
        self.slots = np.zeros(1 << int(64 - self.bits), bool)
        self.slots[(self.grams * _B) >> self.bits] = True

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(place in codes, item, place in item) of every shared q-gram, about HITS at a time."""
        grams = windows(codes)
        at = np.flatnonzero(self.slots[(grams * _B) >> self.bits])
        found = np.searchsorted(self.grams, grams[at])
        found[found == len(self.grams)] = 0
        same = self.grams[found] == grams[at] if len(self.grams) else np.zeros(len(at), bool)
        at, found = at[same], found[same]
        n = self.last[found] - self.first[found]
        cuts = np.searchsorted(np.cumsum(n), np.arange(HITS, n.sum() + HITS, HITS), "left") + 1
        for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
            m = n[a:b]
            if len(m):
                each = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(self.first[found[a:b]], m)
                yield np.repeat(at[a:b], m), self.item[each], self.place[each]

    def regions(self, codes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, lowest start, highest start) of the bands that hold enough shared q-grams.

        Documents start at ``begins`` in the codes, and bands count from there. Bands of starts are twice as wide
        as an item's budget and overlap by half, so the starts that one copy's edits shift fall into one of
        them together. Of a periodic text and item, the shared q-grams are as many as their lengths multiplied; only
        their counts by band are held, which are as many as the text has bands.
        """
        bands, count = np.empty((3, 0), np.int64), np.empty(0, np.int64)
        for at, item, place in self.hits(codes):
            doc = np.searchsorted(begins, at, "right") - 1
            start = at - begins[doc] - place
            low = start // (self.budget[item] + 1)
            key = np.concatenate([np.stack([doc, item, low]), np.stack([doc, item, low - 1])], axis=1)
            own, times = np.unique(key, axis=1, return_counts=True)
            if not len(count):
                bands, count = own, times
                continue
            every = np.concatenate([bands, own], axis=1)
            bands, place_of = np.unique(every, axis=1, return_inverse=True)
            count = np.bincount(place_of.reshape(-1), np.concatenate([count, times]), bands.shape[1]).astype(np.int64)
        for i in np.flatnonzero(count >= self.bound[bands[1]]) if len(count) else ():
            step = int(self.budget[bands[1, i]]) + 1
            yield int(bands[0, i]), int(bands[1, i]), int(bands[2, i]) * step, (int(bands[2, i]) + 2) * step

    def short_copies(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, start, stop) in the codes of every exact copy of a short item that stands between borders of words."""
        if not self.short:
            return
        border = (codes == 32) | (codes == 0)
        begins = np.flatnonzero(~border & np.append(True, border[:-1]))
        for n, held in self.short.items():
            at = begins[begins + n < len(codes)]
            at = at[border[at + n]]
            at = at[np.isin(short_windows(codes, at, n), self.keys[n])]
            for start in at.tolist():
                for item in held.get(spelled(codes[start : start + n]), ()):
                    yield item, start, start + n


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, stop) of the best copy of ``item`` in ``text`` within ``budget`` edits.

    The copy starts from ``low`` to ``high``; only diagonals that the budget can reach are computed.
    Each cell holds the edits and the start they belong to.
    """
    first = low - budget
    width = high - low + 2 * budget + 1
    padded = np.zeros(width + len(item) + 1, np.int64)
    a, b = max(0, first), min(len(text), first + len(padded))
    padded[max(0, -first) : max(0, -first) + max(0, b - a)] = text[a:b]
    one = 1 << 40
    steps = np.arange(width, dtype=np.int64) * one
    row = np.arange(width, dtype=np.int64)
    for i, symbol in enumerate(item.tolist()):
        new = row + one * (padded[i : i + width] != symbol)  # keep or change
        new[:-1] = np.minimum(new[:-1], row[1:] + one)  # the text lacks the symbol
        row = np.minimum.accumulate(new - steps) + steps  # the text has more
    best = int(row.argmin())
    edits, origin = divmod(int(row[best]), one)
    if edits > budget:
        return None
    return edits, first + origin, first + best + len(item)


def _search(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        names_of = [spelled(c) for c in known.codes]
        for batch in W.pieces(batches, "text", 1 << 20):
            texts = [(t or "").replace("\0", " ") for t in batch.column("text").to_pylist()]
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            codes, at = folded("\0".join(texts) + "\0")
            out = set()
            ends = np.flatnonzero(codes == 0)
            begins = np.append(0, ends[:-1] + 1)
            for doc, i, low, high in known.regions(codes, begins):
                item, k = known.codes[i], int(known.budget[i])
                own, places = (x[begins[doc] : ends[doc]] for x in (codes, at))
                a = max(0, low - k)
                near = spelled(own[a : high + len(item) + k])
                exact = near.find(names_of[i])
                copy = (0, a + exact, a + exact + len(item)) if exact >= 0 else aligned(item, own, low, high, k)
                if copy:
                    edits, start, stop = copy  # over an edge of the document where symbols of the item are missing
                    first, last = places[max(0, start)], places[min(stop, len(places)) - 1]
                    out.add((doc, known.ids[i], int(first - starts[doc]), int(last - starts[doc]) + 1, edits))
            for i, start, stop in known.short_copies(codes):
                doc = int(np.searchsorted(begins, start, "right")) - 1
                out.add((doc, known.ids[i], int(at[start] - starts[doc]), int(at[stop - 1] - starts[doc]) + 1, 0))
            rows = sorted(out, key=str)
            names, of = [c for c in batch.schema.names if c != "text"], pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(of) for c in names],
                    *[pa.array([r[c] for r in rows], pa.int64()) for c in range(1, 5)],
                ],
                [*names, "item_id", "start", "stop", "edits"],
            )

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, part: int = PART, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep``, item_id, start, stop, edits) of every copy of ``benchmark(item_id, text)`` in ``docs(doc_id, text)``.

    Texts are compared by their letters and digits in lower case; start and stop are places in the document's
    own text. A copy is a whole item within EDITS hundredths of its length in insertions, deletions and
    changes, and within one document. By the q-gram lemma, it shares n - q + 1 - k q windows of q symbols
    with the item, on starts that lie within k of each other; only bands of starts with that many are aligned,
    each with its own document alone. So what stands before or after a document makes no difference to it.
    Every start that survives is reported once for each band, so a copy in two bands may appear with one
    place or two equal ones, which are merged.

    The items' windows are broadcast. Their number is checked: a benchmark of more than ``part`` characters is
    searched in several passes of at most about that many, and no item is left out. An item with fewer than q
    symbols has no window; it is found where a document spells exactly it between borders of words. Null items and ones
    without letters or digits are never found. Null and empty documents hold no copy; equal rows give equal results, reported once for each row's own piece. Further columns are ignored.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // part) or 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, F.col("text").cast("string").alias("text"))
    kind = W.with_columns(texts, ["doc_id", *keep], "item_id long, start long, stop long, edits long")
    out = None
    for i in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect()
        known = spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows]))
        found = texts.mapInArrow(_search(known), kind)
        out = found if out is None else out.unionByName(found)
    return out
