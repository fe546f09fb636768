"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rosterlens.llm import words as W
from rosterlens.session import staged

#: Counts are kept as levels, the whole logarithms to this base; each level is one entry of the filter.
BASE = 1.5
#: Bits and probes of an entry: a key that isn't there passes for level 1 about once in 2,000 times.
BITS, PROBES = 16, 11
#: Weight of the shorter context's probability, in counts.
KAPPA = 20.0
#: Bytes of training text whose n-grams make a segment, and of all segments that are broadcast at most.
SEGMENT, BROADCAST = 32 << 20, 256 << 20
#: Bytes of text whose distinct n-grams are asked for at once where the segments are not broadcast.
ASKED = 4 << 20
#: What ends a text and stands before its first word; no word has a space.
END = W.xxhash.xxh3_64_intdigest(b" end ")

_MARK = np.array([END], np.uint64)
_LEVEL = 0xD6E8FEB86659FD93


def sequence(text: bytes | None, cache: W.WordHashes) -> np.ndarray:
    """Word hashes with the end mark on either side."""
    h = W.hashed(W.lowered_words(text or b""), cache)
    return np.concatenate([_MARK, h, _MARK])


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9).astype(np.int64)


def values(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that share a level; 0 for level 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    return np.where(level > 0, (low + np.maximum(low, np.ceil(BASE ** (level * 1.0) - 1e-9) - 1)) / 2, 0.0)


def _probe(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    x = W.mixed(keys + np.uint64(level * _LEVEL % (1 << 64)))
    return x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


@dataclass
class Filter:
    """Segments of the filter and of the exact word counts, one after another."""

    shift: int  # the key's upper bits say which segment
    sizes: np.ndarray  # bits of each segment
    begins: np.ndarray  # its first byte
    bits: np.ndarray
    words: np.ndarray  # sorted keys of words
    counts: np.ndarray

    def exact(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, keys)
        at[at == len(self.words)] = 0
        if not len(self.words):
            return np.zeros(len(keys), np.int64)
        return np.where(self.words[at] == keys, self.counts[at].astype(np.int64), 0)

    def quantised(self, keys: np.ndarray) -> np.ndarray:
        """Levels found: probes of level 1, 2, ... as long as all bits are set."""
        out = np.zeros(len(keys), np.int64)
        part = (keys >> np.uint64(self.shift)).astype(np.int64) if self.shift < 64 else np.zeros(len(keys), np.int64)
        alive = np.flatnonzero(self.sizes[part] > 0)
        level = 0
        while len(alive):
            level += 1
            a, b = _probe(keys[alive], level)
            for i in range(PROBES):
                own = part[alive]
                bit = (a + np.uint64(i) * b) % self.sizes[own].astype(np.uint64)
                byte = self.bits[self.begins[own] + (bit >> np.uint64(3)).astype(np.int64)]
                ok = (byte >> (np.uint8(7) - (bit & np.uint64(7)).astype(np.uint8))) & 1 == 1
                alive, a, b = alive[ok], a[ok], b[ok]
            out[alive] = level
        return out


def narrow(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0, in as few bytes each as the largest needs; the first byte says how many."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(numbers) or int(numbers.max()) <= np.iinfo(k).max)
    return bytes([int(kind[2])]) + numbers.astype(kind).tobytes()


def widened(octets: bytes) -> np.ndarray:
    return np.frombuffer(octets, f"<u{octets[0]}", offset=1).astype(np.int64)


def _gather(order: int, shift: int):
    """Counts of a task's n-grams, cut up by segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = W.WordHashes()
        for batch in W.pieces(batches, "text", 8 << 20):
            texts = [sequence(t, cache) for t in W.text_bytes(batch.column("text"))]
            rows = []
            for n in range(1, order + 1):
                grams = [W.gram_hashes(t[1:] if n == 1 else t, n) for t in texts]
                keys, counts = np.unique(np.concatenate(grams), return_counts=True)
                part = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
                cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(keys)) if len(keys) else [0]
                for a, b in zip(cut, cut[1:], strict=False):
                    rows.append((int(part[a]), n, keys[a:b].tobytes(), narrow(counts[a:b])))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)],
                    ["segment", "n", "keys", "counts"],
                )

    return run


def _build(table: pa.Table) -> pa.Table:
    """One segment: exact word counts, and the filter's bits for all orders."""
    order = np.array(table.column("n").to_pylist())
    keys = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
    counts = [widened(x) for x in table.column("counts").to_pylist()]
    entries, words = [], (np.empty(0, np.uint64), np.empty(0, np.int64))
    for n in sorted(set(order.tolist())):
        own = np.flatnonzero(order == n)
        k, c = summed(np.concatenate([keys[i] for i in own]), np.concatenate([counts[i] for i in own]))
        if n == 1:
            words = (k, c)
        entries.append((k, levels(c)))
    total = int(sum(q.sum() for _, q in entries))
    size = -(-total * BITS // 8) * 8
    bits = np.zeros(size, bool)
    for k, q in entries:
        for level in range(1, int(q.max()) + 1):
            a, b = _probe(k[q >= level], level)
            for i in range(PROBES):
                bits[(a + np.uint64(i) * b) % np.uint64(size)] = True
    k, c = words
    return pa.table(
        {
            "segment": pa.array([table.column("segment")[0].as_py()], pa.int64()),
            "words": pa.array([k.tobytes()], pa.binary()),
            "counts": pa.array([c.astype("<i8").tobytes()], pa.binary()),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
            "tokens": pa.array([int(c.sum())], pa.int64()),
            "types": pa.array([len(c)], pa.int64()),
            "once": pa.array([int((c == 1).sum())], pa.int64()),
            "mass": pa.array([float(values(levels(c)).sum()) if len(c) else 0.0], pa.float64()),
        }
    )


_SEGMENTS = "segment long, words binary, counts binary, bits binary, tokens long, types long, once long, mass double"


@dataclass
class Model:
    """A trained model: its segments as a table, and sums over them."""

    segments: DataFrame
    order: int
    shift: int
    tokens: int
    types: int
    once: int
    mass: float
    size: int  # bytes of all segments


def train(docs: DataFrame, order: int = 2, segment_bytes: int = SEGMENT) -> Model:
    """Count the n-grams of ``docs(text)`` up to ``order`` and build the filter, segment by segment.

    Every task adds up what it has before the shuffle, so a frequent n-gram is one entry for each task. The
    number of segments follows the input's size, so that a segment's n-grams fit one task. No n-gram
    is left out. Null texts are empty: one end mark. Without rows the model knows nothing.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    splits = max(0, math.ceil(math.log2(max(1, total / segment_bytes))))
    shift = 64 - splits
    parts = texts.mapInArrow(_gather(order, shift), "segment long, n int, keys binary, counts binary")
    segments = staged(parts.groupBy("segment").applyInArrow(_build, _SEGMENTS), "uncompressed")
    sums = segments.agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "types", "once", "mass")),
        F.coalesce(F.sum(F.length("words") + F.length("counts") + F.length("bits")), F.lit(0)).alias("size"),
    ).first()
    return Model(segments, order, shift, sums.tokens, sums.types, sums.once, float(sums.mass), sums["size"])


def _assembled(sizes: list[tuple[int, int, int, int]], rows: Iterator[tuple[int, bytes, bytes, bytes]], shift: int) -> Filter:
    """From each segment's number and bytes of words, counts and bits, and then those, in any order.

    Each row is copied to its place, so no more than the filter and one row is held.
    """
    sizes = sorted(sizes)
    parts = [np.empty(sum(x[i] for x in sizes), np.uint8) for i in (1, 2, 3)]
    ends = np.cumsum([x[1:] for x in sizes], axis=0) if sizes else []
    places = {x[0]: [int(e) - n for e, n in zip(end, x[1:], strict=True)] for x, end in zip(sizes, ends, strict=True)}
    bits, begins = np.zeros(1 << (64 - shift), np.int64), np.zeros(1 << (64 - shift), np.int64)
    for segment, *own in rows:
        for part, at, octets in zip(parts, places[segment], own, strict=True):
            part[at : at + len(octets)] = np.frombuffer(octets, np.uint8)
        bits[segment], begins[segment] = 8 * len(own[2]), places[segment][2]
    return Filter(shift, bits, begins, parts[2], parts[0].view(np.uint64), parts[1].view("<i8"))


Lookup = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def _scored(sequences: list[np.ndarray], model: Model, lookup: Lookup) -> list[tuple[int, int, float, float]]:
    """n_tokens, n_known, base_score and score of each text."""
    end = W.gram_hashes(_MARK, 1)
    marks = [W.gram_hashes(s, 1) for s in sequences]
    flat = np.concatenate(marks)
    keys, at = np.unique(np.concatenate([flat, end]), return_inverse=True)
    level, exact = lookup(keys)
    count, known = values(level)[at[:-1]], exact[at[:-1]]
    unseen = max(model.once, 1) / (model.tokens + 1)
    single = np.where(count > 0, (1 - unseen) * count / max(model.mass, 1.0), unseen)
    p = single
    begins = np.cumsum([0, *map(len, sequences)])[:-1]
    shorter = count  # of the gram that ends here, one order less
    for n in range(2, model.order + 1):
        # Where a gram would begin before the text, the shorter context's probability stands.
        grams = np.concatenate([g for s in sequences for g in (np.zeros(min(n - 1, len(s)), np.uint64), W.gram_hashes(s, n))])
        keys, at = np.unique(grams, return_inverse=True)
        found = values(lookup(keys)[0])
        found[keys == 0] = 0
        raw = found[at]
        context = np.append(0.0, shorter[:-1])
        context[begins] = 0
        p = (np.minimum(raw, np.minimum(context, count)) + KAPPA * p) / (context + KAPPA)
        shorter = raw
    base = np.log10((known + 1) / (model.tokens + model.types + 1))
    own = np.log10(np.minimum(p, 1.0))
    seen = (known > 0).astype(np.int64)
    for x in (base, own, seen):
        x[begins] = 0  # the first mark is context only
    sums = [np.add.reduceat(x, begins) for x in (seen, base, own)]
    return [(len(s) - 1, int(k), float(b), float(o)) for s, k, b, o in zip(sequences, *sums, strict=True)]


def _columns(batch: pa.RecordBatch, rows: list[tuple], model: Model, leave: set[str]) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c not in leave]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
    found = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    n = pa.array([model.tokens] * len(rows), pa.int64())
    return pa.RecordBatch.from_arrays(
        [*[batch.column(c) for c in names], found[0], found[1], n, found[2], found[3]],
        [*names, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )


_RESULT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, keep: list[str], broadcast_bytes: int = BROADCAST) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the scores of its whole text, one row per row.

    score is the sum of log10 p over words and end. p is p(w) = quantised count / sum of quantised counts,
    less the share of words seen once, which words not seen get; then for each longer context h,
    (c(h w) + KAPPA p) / (c(h) + KAPPA) with the filter's counts. Null and empty texts are one end.
    Further columns are ignored.

    The segments are broadcast if they have at most ``broadcast_bytes``; beyond that, the distinct n-grams of the
    documents go to the segments and their levels come back. Both ways give the same scores.
    """
    spark = docs.sparkSession
    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = W.with_columns(docs, keep, _RESULT)
    plain = Model(None, model.order, model.shift, model.tokens, model.types, model.once, model.mass, model.size)
    if model.size > broadcast_bytes:
        return _score_by_shuffle(rows, model, plain, schema)
    sizes = model.segments.select("segment", F.length("words"), F.length("counts"), F.length("bits")).collect()
    parts = model.segments.select("segment", "words", "counts", "bits").toLocalIterator()
    held = spark.sparkContext.broadcast(_assembled([tuple(r) for r in sizes], parts, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, known = W.WordHashes(), held.value
        for batch in W.pieces(batches, "text"):
            sequences = [sequence(t, cache) for t in W.text_bytes(batch.column("text"))]
            found = _scored(sequences, plain, lambda keys: (known.quantised(keys), known.exact(keys)))
            yield _columns(batch, found, plain, {"text"})

    return rows.mapInArrow(run, schema)


def _answer(known: Filter, keys: np.ndarray) -> tuple[bytes, bytes]:
    """Levels of keys, a byte each, its upper bit set where a key is a word; and the exact counts of those."""
    level, exact = known.quantised(keys), known.exact(keys)
    return (level | np.where(exact > 0, 128, 0)).astype(np.uint8).tobytes(), narrow(exact[exact > 0])


def _score_by_shuffle(rows: DataFrame, model: Model, plain: Model, schema: StructType) -> DataFrame:
    """Scores where the filter is too large to broadcast.

    Documents are dealt into groups of about ASKED bytes. A group asks once for each of its distinct n-grams, so a hot one
    is one key a group, and a segment answers in the order of the keys, a byte each and the counts of words. A segment is
    sent once for as much text as it was made of (``turn``).
    """
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // ASKED))
    order, shift = model.order, model.shift
    turns = max(1, -(-total // (SEGMENT << (64 - shift))))
    names = [c for c in rows.columns if c != "text"]
    rows = rows.withColumn("ask", F.pmod(F.xxhash64(*names, "text"), F.lit(groups)).cast("long"))
    rows = rows.repartition("ask")

    def wanted(group: pa.Table) -> np.ndarray:
        cache, keys = W.WordHashes(), np.empty(0, np.uint64)
        for batch in W.pieces(iter(group.combine_chunks().to_batches()), "text", 1 << 20):
            held = [sequence(t, cache) for t in W.text_bytes(batch.column("text"))]
            keys = np.unique(np.concatenate([keys, *(W.gram_hashes(s, n) for s in held for n in range(1, order + 1))]))
        return keys

    def asks(group: pa.Table) -> pa.Table:
        ask, keys = group.column("ask")[0].as_py(), wanted(group)
        part = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
        cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(keys))
        out = [(ask, int(part[a]), ask % turns, keys[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["of", "segment", "turn", "keys"])

    def answer(asked: pa.Table, segment: pa.Table) -> pa.Table:
        known = Filter(64, np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint8), np.empty(0, np.uint64), np.empty(0, np.int64))
        if segment.num_rows:
            own = segment.slice(0, 1).to_pylist()[0]
            three = own["words"], own["counts"], own["bits"]
            known = _assembled([(0, *map(len, three))], iter([(0, *three)]), 64)
        found = [_answer(known, np.frombuffer(k, np.uint64)) for k in asked.column("keys").to_pylist()]
        level, exact = ([f[i] for f in found] for i in (0, 1))
        return pa.table({"of": asked.column("of"), "part": asked.column("segment"), "level": pa.array(level, pa.binary()), "exact": pa.array(exact, pa.binary())})

    asked = rows.groupBy("ask").applyInArrow(asks, "of long, segment long, turn long, keys binary")
    every = model.segments.select("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(turns - 1).cast("long"))).alias("turn"), "words", "counts", "bits")
    answers = asked.groupBy("segment", "turn").cogroup(every.groupBy("segment", "turn")).applyInArrow(answer, "of long, part long, level binary, exact binary")

    def run(group: pa.Table, given: pa.Table) -> pa.Table:
        keys = wanted(group)
        parts = sorted(zip(*(given.column(c).to_pylist() for c in ("part", "level", "exact")), strict=True))
        level = np.concatenate([np.frombuffer(p[1], np.uint8) for p in parts])
        exact = np.zeros(len(keys), np.int64)
        exact[level >= 128] = np.concatenate([widened(p[2]) for p in parts])
        level = (level & 127).astype(np.int64)

        def lookup(wanted):
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            same = keys[at] == wanted
            return np.where(same, level[at], 0), np.where(same, exact[at], 0)

        cache, done = W.WordHashes(), []
        for batch in W.pieces(iter(group.combine_chunks().to_batches()), "text", 1 << 20):
            found = _scored([sequence(t, cache) for t in W.text_bytes(batch.column("text"))], plain, lookup)
            done.append(_columns(batch, found, plain, {"text", "ask"}))
        return pa.Table.from_batches(done)

    return rows.groupBy("ask").cogroup(answers.groupBy("of")).applyInArrow(run, schema)


def held_out(doc_id: str | Column, parts: int) -> Column:
    """Whether a row is left out of training: crc32 of doc_id as text, modulo ``parts``, is 2; false for null."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(parts)) == 2, F.lit(False))
