"""Removal of passages that occur before, found by anchors at the places of a difference cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlens.llm import words as W
from rosterlens.session import staged

#: Words of a window, in production.
WIDTH = 20
#: Anchors lie at the places of COVER modulo PERIOD: every difference modulo PERIOD is one of two members of COVER.
PERIOD, COVER = 7, (0, 1, 3)
#: Bytes of text that are worked on together, and entries that meet in one group of a shuffle, both about.
PIECE, ENTRIES = 4 << 20, 1 << 20

#: Multipliers of the two rolling hashes, and what makes the second one's words differ.
ROLL_A, ROLL_B = 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F
OTHER = np.uint64(0x165667B19E3779F9)
NO_ID = (1 << 63) - 1


def rolled(h: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours from running sums of h[i] * factor ** i, modulo 2 ** 64."""
    if len(h) < width:
        return np.empty(0, np.uint64)
    back = pow(factor, -1, 1 << 64)
    powers = np.full(len(h), factor, np.uint64)
    powers[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(powers))])
    powers[1:] = back
    return W.mixed((sums[width:] - sums[: len(h) - width + 1]) * np.cumprod(powers)[: len(h) - width + 1])


def _pieces(size: int):
    """Documents in pieces of about ``size`` bytes of text, in the order of (doc_id, tie), nulls last; texts compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        room, made, task = 0, 0, TaskContext.get().partitionId() << 32

        def piece() -> pa.RecordBatch:
            held.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            ids, ties, texts = zip(*held, strict=True)
            blob = zstandard.ZstdCompressor(level=3).compress(b"\n".join(texts))
            row = [[task + made], [list(ids)], [list(ties)], [list(map(len, texts))], [room], [blob]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _PIECES.types, strict=True)], schema=_PIECES)

        for batch in W.pieces(batches, "text", size):
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("tie").to_pylist(), W.text_bytes(batch.column("text")), strict=True)
            for doc_id, tie, text in rows:
                held.append((doc_id, tie, text or b""))
                room += len(text or b"") + 1
                if room >= size:
                    yield piece()
                    held, room, made = [], 0, made + 1
        if held:
            yield piece()

    return run


_PIECES = pa.schema(
    [
        ("piece", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("ties", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
        ("size", pa.int64()), ("blob", pa.binary()),
    ]
)
PIECES = "piece long, doc_ids array<long>, ties array<long>, lengths array<long>, size long, blob binary"


class Piece:
    """The words of a piece, numbered through, and which of its documents they lie in."""

    def __init__(self, row: dict, width: int):
        self.row, self.width = row, width
        self.text = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, row["size"]))
        octets = np.frombuffer(self.text, np.uint8)
        lengths = np.array(row["lengths"], np.int64)
        self.begins = np.cumsum(lengths + 1) - lengths - 1
        starts, ends = W.spans(octets)
        self.hashes = np.empty(len(starts), np.uint64)
        step = 1 << 17  # words hashed at a time, so that what this needs does not grow with the text
        for a in range(0, len(starts), step):
            b = min(a + step, len(starts))
            base = starts[a]
            self.hashes[a:b] = W.span_hashes(octets[base : ends[b - 1]], starts[a:b] - base, ends[a:b] - base)
        self.first = np.searchsorted(starts, self.begins).astype(np.int64)
        self.n_words = np.diff(np.append(self.first, len(starts)))
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), self.n_words)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The words at which anchors begin, and the anchors' hashes."""
        span = self.width - PERIOD + 1
        keys = rolled(self.hashes, span, ROLL_A)
        place = np.arange(len(keys)) - self.first[self.doc[: len(keys)]]
        n = self.n_words[self.doc[: len(keys)]]
        at = np.flatnonzero((n >= self.width) & (place + span <= n) & np.isin(place % PERIOD, COVER))
        return at, keys[at]

    def windows(self, at: np.ndarray) -> np.ndarray:
        """The first words of all windows that hold an anchor at ``at`` within its first PERIOD words."""
        doc = self.doc[at]
        low = np.maximum(at - PERIOD + 1, self.first[doc])
        high = np.minimum(at, self.first[doc] + self.n_words[doc] - self.width) + 1
        turns = np.zeros(len(self.hashes) + 1, np.int32)
        np.add.at(turns, low, 1)
        np.add.at(turns, high, -1)
        return np.flatnonzero(np.cumsum(turns) > 0)

    def places(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """doc_id, tie and place of words."""
        ids = np.array([NO_ID if i is None else i for i in self.row["doc_ids"]], np.int64)
        return ids[self.doc[at]], np.array(self.row["ties"], np.int64)[self.doc[at]], at - self.first[self.doc[at]]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _cut(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(group, from, to) of sorted keys by their upper bits."""
    part = keys >> np.uint64(shift) if shift < 64 else np.zeros(len(keys), np.uint64)
    edges = [*np.flatnonzero(np.diff(part, prepend=part[:1] ^ np.uint64(1))).tolist(), len(keys)] if len(keys) else []
    for a, b in zip(edges, edges[1:], strict=False):
        yield int(part[a]), a, b


def _known(piece: Piece, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where anchors begin, which of the piece's distinct keys each has, those keys, and which stand several times.

    A key is the group and 32 further bits of the hash: one entry in some thousands is taken for repeated
    though it isn't, which costs a comparison of windows and no more.
    """
    at, full = piece.anchors()
    keys, own, counts = np.unique(full >> np.uint64(32 - bits), return_inverse=True, return_counts=True)
    return at, own, keys, counts > 1


def _anchors(width: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, _, keys, several = _known(Piece(row, width), bits)
            out = [(g, row["piece"], keys[a:b].astype("<u4").tobytes(), np.packbits(several[a:b]).tobytes()) for g, a, b in _cut(keys, 32)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                    ["part", "piece", "keys", "several"],
                )

    return run


def _flags(table: pa.Table, flags: np.ndarray, sizes: list[int]) -> pa.Table:
    """(piece, part, bits, hits) of the pieces with a flag set; ``sizes`` are the pieces' entries."""
    edges = np.cumsum([0, *sizes])
    out = [
        (piece, part, np.packbits(flags[a:b]).tobytes(), int(flags[a:b].sum()))
        for piece, part, a, b in zip(table["piece"].to_pylist(), table["part"].to_pylist(), edges, edges[1:], strict=False)
        if flags[a:b].any()
    ]
    columns = zip(*out, strict=True) if out else [[]] * 4
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("piece", "part", "bits", "hits"), columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)})


FLAGS = "piece long, part long, bits binary, hits long"


def _column(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table[name].to_pylist()]


def _repeated(table: pa.Table) -> pa.Table:
    """Anchors that several pieces have, or one piece several times."""
    keys = _column(table, "keys", "<u4")
    several = [np.unpackbits(s, count=len(k)).astype(bool) for k, s in zip(keys, _column(table, "several", "u1"), strict=True)]
    sizes, flat, flags = list(map(len, keys)), np.concatenate(keys), np.concatenate(several)
    order = np.argsort(flat, kind="stable")
    same = flat[order][1:] == flat[order][:-1]
    flags[order[1:][same]] = True
    flags[order[:-1][same]] = True
    return _flags(table, flags, sizes)


def _set(row: dict, name: str, keys: np.ndarray, shift: int) -> np.ndarray:
    """Which of the sorted keys have a flag in the row's column ``name``."""
    given = {x["part"]: x["bits"] for x in row[name] or ()}
    out = np.zeros(len(keys), bool)
    for part, a, b in _cut(keys, shift):
        if part in given:
            out[a:b] = np.unpackbits(np.frombuffer(given[part], np.uint8), count=b - a)
    return out


class Candidates:
    """Windows of a piece around repeated anchors; equal ones are one entry, that of the first of them."""

    def __init__(self, row: dict, width: int, bits: int):
        self.piece = piece = Piece(row, width)
        at, own, keys, _ = _known(piece, bits)
        hit = _set(row, "anchors", keys, 32)
        self.at = piece.windows(at[hit[own]]) if len(at) else at
        a = rolled(piece.hashes, width, ROLL_A)[self.at]
        b = rolled(W.mixed(piece.hashes ^ OTHER), width, ROLL_B)[self.at]
        order = np.lexsort((b, a))
        new = np.ones(len(order), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        firsts = order[new]  # sorting keeps the order of equal ones
        self.a, self.b, self.first = a[firsts], b[firsts], self.at[firsts]

    def later(self) -> np.ndarray:
        """Windows that stand after their entry's: rows with one doc_id and one text are one document."""
        own, first = self.piece.places(self.at), self.piece.places(self.first[self.entry])
        return (own[0] != first[0]) | (own[1] != first[1]) | (own[2] != first[2])


def _entries(width: int, bits: int, window_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            if not row["anchors"]:
                continue
            found = Candidates(row, width, bits)
            ids, ties, at = found.piece.places(found.first)
            out = [
                (g, row["piece"], found.a[x:y].tobytes(), found.b[x:y].tobytes(), ids[x:y].tobytes(), ties[x:y].tobytes(), at[x:y].astype("<i4").tobytes())
                for g, x, y in _cut(found.a, 64 - window_bits)
            ]
            if out:
                kinds = (pa.int64(), pa.int64(), *[pa.binary()] * 5)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)],
                    ["part", "piece", "a", "b", "ids", "ties", "at"],
                )

    return run


ENTRY = "part long, piece long, a binary, b binary, ids binary, ties binary, at binary"


def _preceded(table: pa.Table) -> pa.Table:
    """Entries whose words stand at an earlier place of another piece."""
    kinds = {"a": "<u8", "b": "<u8", "ids": "<i8", "ties": "<i8", "at": "<i4"}
    sizes = [len(x) // 4 for x in table["at"].to_pylist()]
    a, b, ids, ties, at = (np.concatenate(_column(table, n, k)) for n, k in kinds.items())
    order = np.lexsort((at, ties, ids, b, a))
    a, b, ids, ties, at = (x[order] for x in (a, b, ids, ties, at))
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    flags = np.empty(len(order), bool)
    flags[order] = (ids != ids[first]) | (ties != ties[first]) | (at != at[first])
    return _flags(table, flags, sizes)


def _kept(width: int, bits: int, window_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            found = Candidates(row, width, bits)
            piece = found.piece
            gone = found.later() | _set(row, "windows", found.a, 64 - window_bits)[found.entry]
            turns = np.zeros(len(piece.hashes) + 1, np.int64)
            np.add.at(turns, found.at[gone], 1)
            np.add.at(turns, found.at[gone] + width, -1)
            covered = np.cumsum(turns[:-1]) > 0
            counts = np.concatenate([np.zeros(1, np.int64), np.cumsum(covered)])
            stops = piece.first + piece.n_words
            removed = counts[stops] - counts[piece.first]
            texts, spans = [], []
            for i, (begin, size) in enumerate(zip(piece.begins.tolist(), row["lengths"], strict=True)):
                own = piece.text[begin : begin + size].split()
                runs = []
                if removed[i]:
                    out = covered[piece.first[i] : stops[i]]
                    edges = np.flatnonzero(np.diff(out, prepend=False, append=False))
                    runs = [{"start": s, "length": e - s} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
                    left, after = [], 0
                    for run in runs:
                        left += own[after : run["start"]]
                        after = run["start"] + run["length"]
                    own = left + own[after:]
                texts.append(b" ".join(own))
                spans.append(runs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(piece.n_words, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "n_removed", "spans", "kept"],
            )

    return run


KEPT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,length:long>>, kept string"


def _bits(entries: float, room: int) -> int:
    """Bits of a hash that make groups of about ``room`` entries."""
    return max(0, int(np.ceil(np.log2(max(entries, 1) / room))))


def without_repeats(docs: DataFrame, width: int = WIDTH, piece: int = PIECE, room: int = ENTRIES) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, n_words, n_removed, spans (start, length in words), kept (text).

    A window is ``width`` words in a row of one document; words are runs without ASCII white space, unchanged. A word
    goes if it lies in a window whose words also begin earlier: in a document of smaller doc_id, or before in the same
    one. Windows are judged on the input. What is left is joined by one space.

    1. Documents are staged in pieces of about ``piece`` bytes (a longer text is one by itself).
    2. Runs of ``width`` - PERIOD + 1 words are hashed at the places of COVER modulo PERIOD only. Two equal windows, wherever
       they begin, have such an anchor at the same place within their first PERIOD words. Distinct anchors of a piece,
       four bytes each, meet by hash; a bit comes back for each that isn't alone.
    3. Those are extended to the windows around them. Equal ones of a piece are one entry, and entries meet by a
       128-bit hash with their places, so a passage in very many documents is one entry for each piece. A bit
       comes back for each that stands earlier elsewhere. No pairs are made at any point.

    Texts cross the network once, compressed, for both joins of bits with pieces. Groups follow the input's size, so that
    one holds about ``room`` entries.

    Null and empty texts have no word and an empty text is kept. Rows without doc_id come after all others. Rows with
    one doc_id are different documents in the order of a hash of their texts, but equal rows are one: all keep the same
    words. An empty table gives no rows; further columns are ignored.
    """
    if width < PERIOD:
        raise ValueError(f"a window has {PERIOD} words at least")
    doc_id, text = docs["doc_id"].cast("long"), docs["text"].cast("string")
    base = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    single = base.groupBy("doc_id").count().where("count > 1").isEmpty()
    tie = F.lit(0).cast("long") if single else F.xxhash64("text")
    pieces = staged(base.select("doc_id", tie.alias("tie"), "text").mapInArrow(_pieces(piece), PIECES), "none")

    words = (pieces.agg(F.sum("size")).first()[0] or 0) / 6
    bits = _bits(words * len(COVER) / PERIOD, room)
    anchors = pieces.mapInArrow(_anchors(width, bits), "part long, piece long, keys binary, several binary")
    repeated = staged(anchors.groupBy("part").applyInArrow(_repeated, FLAGS))
    hits = repeated.agg(F.sum("hits")).first()[0] or 0
    window_bits = _bits(hits * PERIOD / len(COVER), room)

    def by_piece(flags: DataFrame, name: str) -> DataFrame:
        return flags.groupBy("piece").agg(F.collect_list(F.struct("part", "bits")).alias(name))

    marked = pieces.join(by_piece(repeated, "anchors"), "piece", "left")
    entries = marked.mapInArrow(_entries(width, bits, window_bits), ENTRY)
    preceded = entries.groupBy("part").applyInArrow(_preceded, FLAGS)
    return marked.join(by_piece(preceded, "windows"), "piece", "left").mapInArrow(_kept(width, bits, window_bits), KEPT)
