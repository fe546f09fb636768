"""Token ids in files of compressed bit or byte planes, with a chunk index."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlens.llm import words as W
from rosterlens.session import staged

#: Ids of a block, zstandard level, pieces of text whose ids a task keeps.
BLOCK = 1 << 16
LEVEL = 3
HELD = 300_000
#: ASCII signs without those of special tokens and shortened words.
_SIGNS = b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
_IS_SIGN = np.isin(np.arange(256), list(_SIGNS))
_IS_CAPITAL = np.isin(np.arange(256), range(0x41, 0x5B))
_IS_ODD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E), *range(0x41, 0x5B), *range(0x61, 0x7B)])
#: Bytes of the longest run whose ids are kept for later texts.
LONGEST = 256

CHUNKS = (
    "shard int, chunk int, first long, n_ids int, kind string, planes array<binary>, "
    "row long, doc_ids array<long>, starts array<long>, lengths array<long>"
)


def to_planes(ids: np.ndarray, kind: str = "byte", level: int = LEVEL) -> list[bytes]:
    """The planes of one block of unsigned 32-bit ids, lowest first, each compressed by itself."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        planes = octets.T
    elif kind == "bit":
        planes = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1)
    else:
        raise ValueError(f"no such planes: {kind}")
    packer = zstandard.ZstdCompressor(level=level)
    return [packer.compress(np.ascontiguousarray(p).tobytes()) for p in planes]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    """The ids of a block back."""
    unpacker = zstandard.ZstdDecompressor()
    raw = [np.frombuffer(unpacker.decompress(p), np.uint8) for p in planes]
    if kind == "byte":
        return np.stack(raw, axis=1).reshape(-1).view("<u4")
    bits = np.unpackbits(np.stack(raw), axis=1, count=n)
    return np.packbits(bits.T, axis=1, bitorder="little").reshape(-1).view("<u4")


class LibraryIds:
    """Ids by the tokenizers library; each distinct run of letters or of signs goes to it once.

    The file's normalizer and pattern never join what ASCII white space parts, nor letters and the ASCII signs
    after them. So the runs' ids one after another are the text's, and ASCII letters may be lower-cased
    before. Words of ASCII letters and signs after them are parted in the text as a whole, other words one by one. What is
    neither goes to the library as it is. Ids are kept by the run's hash, for runs of up to LONGEST bytes.
    """

    def __init__(self, spec: str, held: int = HELD):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the machine already
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec)
        self.model.no_truncation()
        self.model.no_padding()
        self.held = held
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self.known, self.old = {}, {}  # by hash: the newest ``held``, and those before them

    @staticmethod
    def parted(word: bytes) -> tuple[tuple[bytes, ...], bool]:
        """Runs whose ids make up the word's, and whether each is letters only or signs only: letters and signs, or the word alone."""
        letters = word.rstrip(_SIGNS)
        if not letters:
            return (word,), True
        low = letters.decode("utf-8", "replace").lower()  # a letter's lower case may have a mark of its own
        if not low.isalpha():
            return (word,), False
        return ((word,) if len(letters) == len(word) else (letters, word[len(letters) :])), True

    @staticmethod
    def runs(octets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(octets, starts, ends, plain, words): a text with its words of ASCII letters lower-cased, cut before the signs that
        end those; which runs need no further look; and the first run of each word."""
        starts, ends = W.spans(octets)
        cuts, signs = ends.copy(), np.flatnonzero(_IS_SIGN[octets[ends - 1]])
        for _ in range(8):
            cuts[signs] -= 1
            signs = signs[cuts[signs] > starts[signs]]
            signs = signs[_IS_SIGN[octets[cuts[signs] - 1]]]
        for i in signs.tolist():  # more than eight signs at the end
            word = octets[starts[i] : cuts[i]]
            solid = np.flatnonzero(~_IS_SIGN[word])
            cuts[i] = starts[i] + (int(solid[-1]) + 1 if len(solid) else 0)
        ascii_word = cuts > starts
        odd = np.flatnonzero(_IS_ODD[octets])  # neither letters nor white space
        word = np.searchsorted(starts, odd, "right") - 1
        ascii_word[word[odd < cuts[word]]] = False
        two = ascii_word & (cuts < ends)
        before = np.arange(len(starts)) + np.cumsum(two) - two
        n = len(starts) + int(two.sum())
        run_starts, run_ends, plain = np.empty(n, np.int64), np.empty(n, np.int64), np.ones(n, bool)
        run_starts[before], run_ends[before], plain[before] = starts, np.where(two, cuts, ends), ascii_word
        run_starts[before[two] + 1], run_ends[before[two] + 1] = cuts[two], ends[two]
        capital = np.flatnonzero(_IS_CAPITAL[octets])
        capital = capital[ascii_word[np.searchsorted(starts, capital, "right") - 1]]
        lowered = octets.copy()
        lowered[capital] |= 0x20
        return lowered, run_starts, run_ends, plain, before

    def _by_library(self, runs: list[bytes]) -> list[bytes]:
        """Ids of any runs, each by itself."""
        out = []
        for start in range(0, len(runs), 20_000):
            part = [r.decode("utf-8", "replace") for r in runs[start : start + 20_000]]
            out += [array("I", x.ids).tobytes() for x in self.model.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def _plain_by_library(self, runs: list[bytes]) -> list[bytes]:
        """Ids of runs that are letters only or signs only, many to a text.

        Each is one word to the library, whose last token, and no other, has the mark of a word's end. Where the number
        of marks is not that of the runs, they go by themselves.
        """
        out = []
        for start in range(0, len(runs), 2_000):
            part = runs[start : start + 2_000]
            ids = np.array(self.model.encode(b" ".join(part).decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")
            stops = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            if len(stops) != len(part) or stops[-1] != len(ids):
                out += self._by_library(part)
                continue
            flat = ids.tobytes()
            out += [flat[4 * a : 4 * b] for a, b in zip([0, *stops], stops, strict=False)]
        return out

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.known) > self.held:
            self.known, self.old = {}, self.known
        octets, starts, ends, plain, words = self.runs(np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8))
        text = octets.tobytes()
        at, distinct = pd.factorize(W.span_hashes(octets, starts, ends))
        first = np.empty(len(distinct), np.int64)
        first[at[::-1]] = np.arange(len(at) - 1, -1, -1)
        keys = distinct.tolist()
        found = list(map(self.known.get, keys))
        new = []
        for i in [i for i, x in enumerate(found) if x is None]:
            if (ids := self.old.get(keys[i])) is None:
                new.append(i)
            else:
                self.known[keys[i]] = found[i] = ids
        if new:
            spots = first[new]
            cut = [text[a:b] for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)]
            simple, other = np.flatnonzero(plain[spots]).tolist(), np.flatnonzero(~plain[spots]).tolist()
            parts = [self.parted(cut[j]) for j in other]
            easy = list({r for runs, alike in parts if alike for r in runs})
            hard = [runs[0] for runs, alike in parts if not alike]
            of_run = dict(zip(hard, self._by_library(hard), strict=True))
            ids = self._plain_by_library([cut[j] for j in simple] + easy)
            of_run.update(zip(easy, ids[len(simple) :], strict=True))
            made = [*zip(simple, ids, strict=False), *((j, b"".join([of_run[r] for r in runs])) for j, (runs, _) in zip(other, parts, strict=True))]
            for j, own in made:
                found[new[j]] = own
                if len(cut[j]) <= LONGEST:
                    self.known[keys[new[j]]] = own
        flat = np.frombuffer(b"".join(found), np.uint32)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(lengths) - lengths
        own = lengths[at]
        upto = np.append(0, np.cumsum(own))
        ids = flat[np.arange(upto[-1]) + np.repeat(begins[at] - upto[:-1], own)]
        texts_at = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
        edges = upto[np.searchsorted(starts, texts_at)]
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def _pack(spec, end: int, block: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = LibraryIds(spec.value)
        shard = TaskContext.get().partitionId()
        chunk = total = row = held = 0
        ids: list[np.ndarray] = []
        docs: list[tuple[int, int | None, int, int]] = []  # row, doc_id, start, length

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal chunk, ids, docs, held
            flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
            done = 0
            while len(flat) - done >= block or (last and done < len(flat)):
                part = flat[done : done + block]
                first = total - len(flat) + done
                here = [d for d in docs if d[2] < first + len(part)]
                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "shard": shard, "chunk": chunk, "first": first, "n_ids": len(part), "kind": kind,
                            "planes": to_planes(part, kind), "row": here[0][0],
                            "doc_ids": [d[1] for d in here], "starts": [d[2] for d in here], "lengths": [d[3] for d in here],
                        }
                    ],
                    schema=_ARROW,
                )
                done += len(part)
                chunk += 1
                docs = [d for d in docs if d[2] + d[3] > first + len(part)]
            ids = [flat[done:]]
            held = len(flat) - done

        for batch in W.pieces(batches, "text"):
            encoded = library.encode(W.text_bytes(batch.column("text")))
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                docs.append((row, doc_id, total, len(own) + 1))
                ids += [own, np.array([end], np.uint32)]
                held += len(own) + 1
                total += len(own) + 1
                row += 1
                if held >= 4 * block:
                    yield from rows(False)
        yield from rows(True)

    return run


_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()),
        ("planes", pa.list_(pa.binary())), ("row", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
    ]
)


def write_ids(docs: DataFrame, path: str, spec, end: int = 1, block: int = BLOCK, kind: str = "byte") -> None:
    """Encode ``docs(doc_id, text)``, append ``end`` to each and write the ids to a folder.

    A shard holds a range of doc_id in ascending order; ranges are as many as the input's splits. Within a
    shard, blocks of ``block`` ids (the last may be shorter) are stored as planes, whatever document they
    belong to. ``path/chunks`` has one Parquet row for each block: the compressed planes, its place in the
    shard, and which documents it holds from which id on. ``path/index`` has the global place of each
    block, so a reader of an id range opens only the blocks it needs. Spark's writer commits the files,
    so any file system it knows will do and a lost task leaves nothing behind.

    Rows without doc_id come first; rows with one doc_id follow each other in the order of a hash of the
    text. A null text is empty, so it has the end id alone. An empty table gives empty folders.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = max(1, rows.rdd.getNumPartitions())
    (
        rows.withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(ranges, "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
        .mapInArrow(_pack(spec, end, block, kind), CHUNKS)
        .write.option("compression", "uncompressed")
        .parquet(f"{path}/chunks")
    )
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("shard", "chunk", "first", "n_ids")
    (
        chunks.join(_bases(chunks), "shard")
        .select("shard", "chunk", (F.col("base") + F.col("first")).alias("first"), "n_ids")
        .write.parquet(f"{path}/index")
    )


def _bases(chunks: DataFrame) -> DataFrame:
    """(shard, base): ids before each shard. One row for each task that wrote."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that lie within one block with their checksum, pieces of the others with their ids."""
    for batch in batches:
        planes = batch.column("planes")
        for i, (shard, chunk, first, n_ids, kind, row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk", "first", "n_ids", "kind", "row")), strict=True)):
            ids = memoryview(from_planes(planes[i].as_py(), n_ids, kind).tobytes())
            starts, lengths = (batch.column(c)[i].values.to_numpy() for c in ("starts", "lengths"))
            begins, ends = starts - first, starts + lengths - first
            whole = (begins >= 0) & (ends <= n_ids)
            spans = zip(np.maximum(4 * begins, 0).tolist(), np.minimum(4 * ends, 4 * n_ids).tolist(), whole.tolist(), strict=True)
            crcs, parts = zip(*((zlib.crc32(ids[a:b]), None) if w else (None, bytes(ids[a:b])) for a, b, w in spans), strict=True)
            n = len(starts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, shard, np.int32)), pa.array(np.arange(row, row + n)), batch.column("doc_ids")[i].values,
                    pa.array(starts), pa.array(lengths), pa.array(np.full(n, chunk, np.int32)), pa.array(crcs, pa.int64()), pa.array(parts, pa.binary()),
                ],
                schema=_PIECES,
            )


_PIECES = pa.schema(
    [
        ("shard", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
        ("chunk", pa.int32()), ("crc", pa.int64()), ("ids", pa.binary()),
    ]
)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids before it), n_tokens, ids_crc32.

    Blocks are read where they lie. Only documents that cross a block's border move: their pieces meet
    under the document's own key.
    """
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    schema = "shard int, row long, doc_id long, start long, n_tokens long, chunk int, crc long, ids binary"
    pieces = staged(chunks.mapInArrow(_unpack, schema))  # a checksum for most documents; ids of those at borders only
    found = ["shard", "row", "doc_id", "start", "n_tokens", "crc"]
    whole = pieces.where("crc is not null").select(*found)
    parts = F.sort_array(F.collect_list(F.struct("chunk", "ids")))
    crossing = (
        pieces.where("crc is null")
        .groupBy("shard", "row")
        .agg(*[F.first(c).alias(c) for c in ("doc_id", "start", "n_tokens")], parts.alias("parts"))
        .withColumn("crc", F.crc32(F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["ids"])), ""))))
    )
    joined = whole.unionByName(crossing.select(*found))
    bases = _bases(chunks.select("shard", "n_ids"))
    return joined.join(bases, "shard").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", F.col("crc").alias("ids_crc32")
    )


def read_ids(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """(first, ids) of the blocks that hold the ids from ``start`` to before ``stop``, cut to that range.

    The index says which blocks those are; the others' planes are not read, nor are files of shards that hold none.
    """
    index = spark.read.parquet(f"{path}/index").where((F.col("first") < stop) & (F.col("first") + F.col("n_ids") > start))
    edge = index.agg(F.min("shard").alias("low"), F.max("shard").alias("high")).first()
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("shard", "chunk", "kind", "planes")
    if edge.low is None:
        chunks = chunks.limit(0)
    else:
        chunks = chunks.where(F.col("shard").between(edge.low, edge.high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = from_planes(r["planes"], r["n_ids"], r["kind"])
                a, b = max(start - r["first"], 0), min(stop - r["first"], r["n_ids"])
                yield pa.RecordBatch.from_pydict({"first": [r["first"] + a], "ids": [ids[a:b].astype(np.int64)]}, schema=_RANGE)

    found = chunks.join(index, ["shard", "chunk"]).select("first", "n_ids", "kind", "planes")
    return found.mapInArrow(run, "first long, ids array<long>")


_RANGE = pa.schema([("first", pa.int64()), ("ids", pa.list_(pa.int64()))])
