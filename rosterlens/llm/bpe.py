"""Byte-pair encoding by backtracking over longest matches, decoding from an offset table."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm import words as W

#: Distance that marks a symbol as the last of its word.
LAST = 0x1000
#: Words whose ids a task keeps, twice.
HELD = 200_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class OffsetTable:
    """Entries laid end to end, and where each begins."""

    def __init__(self, entries: list[bytes]):
        self.offsets = np.zeros(len(entries) + 1, np.int64)
        np.cumsum([len(e) for e in entries], out=self.offsets[1:])
        self.lengths = np.diff(self.offsets)
        self.blob = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        """The entries of ``ids``, one after the other."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if not len(ids):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.offsets[ids] - (ends - lengths), lengths)
        return self.blob[at].tobytes()


@dataclass
class Vocabulary:
    """A byte-level vocabulary with word ends, as its file states it."""

    names: list[str]  # by id
    pairs: dict[tuple[int, int], int]  # what two neighbours merge into; a lower id merges first
    special: dict[str, int]  # each has a "<", which spares most texts a search
    pattern: str
    suffix: str

    @classmethod
    def read(cls, text: str) -> Vocabulary:
        """From a tokenizers file; others than lower-casing BPE with a word-end suffix are refused."""
        spec = json.loads(text)
        model, pre = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        named = [t["content"] for t in spec["added_tokens"]]
        if not all("<" in n for n in named) or model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError("a BPE file with end_of_word_suffix, NFC, lower case and special tokens with < are needed")
        vocab = dict(model["vocab"])
        pairs = {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs[vocab[a], vocab[b]] = vocab[a + b]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for name, i in [*vocab.items(), *special.items()]:
            names[i] = name
        return cls(names, pairs, special, pre[0]["pattern"]["Regex"], model["end_of_word_suffix"])

    @cached_property
    def halves(self) -> list[tuple[int, int]]:
        """The two tokens each token is merged from; a symbol is its own halves."""
        out = [(i, i) for i in range(len(self.names))]
        for pair, i in self.pairs.items():
            out[i] = pair
        return out

    @cached_property
    def symbols(self) -> dict[str, str]:
        """Token names of single symbols -> the one character that stands for them here."""
        known = {c: c for c in byte_symbols()}
        return known | {c + self.suffix: chr(ord(c) + LAST) for c in byte_symbols()}

    @cached_property
    def spelled(self) -> dict[int, str]:
        """Each token as a string of symbol characters."""
        out = {i: self.symbols[n] for i, n in enumerate(self.names) if n in self.symbols}
        for (a, b), i in sorted(self.pairs.items(), key=lambda x: x[1]):
            out[i] = out[a] + out[b]
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves ``a`` and ``b`` next to each other as they are.

        Undoes the merges inside both, latest first, and looks whether a pair across the border would have
        merged before.
        """
        limit = 1 << 60
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            inner_a, inner_b = self.halves[a][1], self.halves[b][0]
            if a > b and inner_a != a or a <= b and inner_b == b:
                if inner_a == a:
                    return True
                limit, a = a, inner_a
            else:
                if inner_b == b:
                    return True
                limit, b = b + 1, inner_b

    @cached_property
    def reachable(self) -> list[int]:
        """Tokens that come out of their own spelling: their halves stay apart until they merge."""
        ok = set()
        for i in sorted(self.spelled):
            a, b = self.halves[i]
            if a == b == i or (a in ok and b in ok and self._first_crossing(a, b) == i):
                ok.add(i)
        return sorted(ok)

    def _first_crossing(self, a: int, b: int) -> int | None:
        pair = self.pairs.pop((a, b))
        try:
            return pair if self.compatible(a, b) else None
        finally:
            self.pairs[a, b] = pair


class Encoder:
    """Exact merges of a word in time linear in its length."""

    def __init__(self, vocabulary: Vocabulary, held: int = HELD):
        self.v = vocabulary
        self.size = {i: len(s) for i, s in vocabulary.spelled.items()}
        by_spelling = {vocabulary.spelled[i]: i for i in vocabulary.reachable}
        self.shorter = {}
        for s, i in by_spelling.items():
            cut = next((s[:n] for n in range(len(s) - 1, 0, -1) if s[:n] in by_spelling), None)
            self.shorter[i] = by_spelling[cut] if cut else None
        self.matches = ahocorasick.Automaton()
        for s, i in by_spelling.items():
            self.matches.add_word(s, i)
        self.matches.make_automaton()
        self.pairs_checked: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(vocabulary.pattern).findall
        self.apart = regex.compile("|".join(map(regex.escape, vocabulary.special)) or r"(?!)")
        self.bytes = byte_symbols()
        self.words, self.runs = _Known(self.piece, held), _Known(self.run, held)

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs_checked.get((a, b))
        if known is None:
            if len(self.pairs_checked) > 1_000_000:
                self.pairs_checked.clear()
            known = self.pairs_checked[a, b] = self.v.compatible(a, b)
        return known

    def merge(self, symbols: str) -> list[int]:
        """Tokens of one word, given as symbol characters."""
        longest = self.matches.iter_long  # from a place on, the longest tokens one after another
        tokens: list[int] = []
        dead = set()
        at, total = 0, len(symbols)
        matches = longest(symbols)
        token = next(matches)[1]
        last = None
        while True:
            best = token
            while token is not None:
                end = at + self.size[token]
                if end not in dead and (last is None or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token is None:  # nothing fits here after ``last``: take that back and try it shorter
                dead.add(at)
                token = tokens.pop()
                at -= self.size[token]
                last = tokens[-1] if tokens else None
                matches = None
                continue
            tokens.append(token)
            if end == total:
                return tokens
            at, last = end, token
            if token != best or matches is None:
                matches = longest(symbols, at)
            token = next(matches)[1]

    def run(self, run: str) -> bytes:
        """Ids of one word: a run that the file's pattern splits off."""
        marks = run if run.isascii() and run.isprintable() else "".join([self.bytes[b] for b in run.encode()])
        return array("I", self.merge(marks[:-1] + chr(ord(marks[-1]) + LAST))).tobytes()

    def piece(self, piece: bytes) -> bytes:
        """Ids of a text without ASCII white space."""
        if piece.isalpha():  # ASCII letters only
            return self.runs[piece.decode("ascii").lower()]
        text, at, out = piece.decode("utf-8", "replace"), 0, b""
        for special in [*(self.apart.finditer(text) if "<" in text else ()), None]:
            plain = text[at : special.start() if special else None]
            plain = plain if plain.isascii() else unicodedata.normalize("NFC", plain)
            plain = "".join(map(str.lower, plain)) if "Σ" in plain else plain.lower()
            out += b"".join(map(self.runs.__getitem__, self.split(plain)))
            if special:
                out += np.uint32(self.v.special[special[0]]).tobytes()
                at = special.end()
        return out

    def encode(self, text: bytes | None) -> np.ndarray:
        """Ids of a whole text; none for null."""
        return np.frombuffer(b"".join(map(self.words.__getitem__, (text or b"").split())), np.uint32)


class _Known(dict):
    """Results of a function by its argument: the last ``limit`` and those before them."""

    def __init__(self, fn, limit: int):
        super().__init__()
        self.fn, self.limit, self.before = fn, limit, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.fn(key)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Decoder:
    """The library's decoding of files without a decoder: the tokens' names with spaces between."""

    def __init__(self, vocabulary: Vocabulary):
        self.names = OffsetTable([f"{n} ".encode() for n in vocabulary.names])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.names.joined(ids)[:-1]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One per Python process and file, so tasks share its tables and words."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(Vocabulary.read(spec))
    return _ENCODERS[key]


def load(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast; it is the driver's, of fixed size."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def _others(batch: pa.RecordBatch) -> tuple[list, list]:
    names = [c for c in batch.schema.names if c != "text"]
    return [batch.column(c) for c in names], names


def encoded(docs: DataFrame, spec, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ids (array<int>) of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for batch in W.pieces(batches, "text"):
            columns, names = _others(batch)
            ids = [encoder.encode(t) for t in W.text_bytes(batch.column("text"))]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = pa.array(np.concatenate(ids).view(np.int32))
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets), flat)], [*names, "ids"])

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, W.with_columns(docs, keep, "ids array<int>"))


def decoded(table: DataFrame, spec, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``table(..., ids)`` and text; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary.read(spec.value))
        for batch in batches:
            ids = batch.column("ids")
            texts = [None if x is None else decoder.decode(np.array(x, np.int64)).decode() for x in ids.to_pylist()]
            names = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(texts, pa.string())], [*names, "text"])

    return table.select(*keep, "ids").mapInArrow(run, W.with_columns(table, keep, "text string"))


def round_trip(docs: DataFrame, spec, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with n_tokens, ids_sha256 and decoded_sha256 of each whole text.

    One row per row. Null and empty texts have no tokens; digests are then those of the empty string.
    Further columns are ignored. Ids go from the encoder to the decoder inside the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        decoder = Decoder(encoder.v)
        decimals = OffsetTable([b"%d " % i for i in range(len(encoder.v.names))])
        for batch in W.pieces(batches, "text"):
            columns, names = _others(batch)
            counts, digests, texts = [], [], []
            for text in W.text_bytes(batch.column("text")):
                ids = encoder.encode(text)
                counts.append(len(ids))
                digests.append(hashlib.sha256(decimals.joined(ids)[:-1]).hexdigest())
                texts.append(hashlib.sha256(decoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64()), pa.array(digests), pa.array(texts)],
                [*names, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(
        run, W.with_columns(docs, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    )
