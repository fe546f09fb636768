"""Byte-pair encoding and plane files against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rosterlens.llm import bitplanes, bpe, queries
from rosterlens.llm import words as W


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def own():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        text = f.read()
    return bpe.Encoder(bpe.Vocabulary.read(text)), bitplanes.LibraryIds(text)


SOME = st.text(st.sampled_from("abcdefghijklmnopqrstuvwxyzTHEéèüßΣσİı'́ \x1c\x85-_.!?<|>0129中文😀👍🏽ﬀ½²\n\t%"), max_size=40)
SPECIAL = st.sampled_from(["", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"])


@settings(max_examples=400, deadline=None)
@given(SOME, SPECIAL, SOME)
def test_encoders_equal_the_library(library, own, a, special, b):
    text = a + special + b
    want = library.encode(text, add_special_tokens=False).ids
    ids = own[0].encode(text.encode())
    assert ids.tolist() == want
    assert own[1].encode([text.encode()])[0].tolist() == want
    assert bpe.Decoder(own[0].v).decode(ids).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abtheinors"), min_size=30, max_size=80))
def test_long_words_merge_exactly(library, own, text):
    assert own[0].encode(text.encode()).tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_over_64_kib_that_differ_by_swapped_bytes(library, own):
    first, second = bytearray(b"abcdefghij" * 7_000), bytearray(b"abcdefghij" * 7_000)
    second[0], second[1 << 16] = first[1 << 16], first[0]
    texts = [bytes(first) + b" " + bytes(second), bytes(second), bytes(first), b"X" * 70_000 + b"!" * 70_000]
    for group in (texts, *([t] for t in texts)):
        for text, ids in zip(group, own[1].encode(group), strict=True):
            assert ids.tolist() == library.encode(text.decode(), add_special_tokens=False).ids
    assert all(len(x) <= 4 * bitplanes.LONGEST for x in own[1].known.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBcé'!.9 \n<|>"), max_size=30), max_size=6))
def test_texts_of_a_batch_do_not_mix(library, own, texts):
    got = own[1].encode([t.encode() for t in texts]) if texts else []
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=300), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, kind):
    x = np.array(ids, np.uint32)
    assert (bitplanes.from_planes(bitplanes.to_planes(x, kind), len(x), kind) == x).all()


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=200))
def test_spans_are_the_words(data):
    starts, ends = W.spans(np.frombuffer(data, np.uint8))
    words = [data[a:b] for a, b in zip(starts, ends, strict=True)]
    assert words == data.split()
    hashes = W.span_hashes(np.frombuffer(data, np.uint8), starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))


def test_round_trip_of_odd_documents(odd, nothing, spec, library):
    rows = bpe.round_trip(odd, spec, ["doc_id"]).collect()
    want = []
    for r in odd.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert bpe.round_trip(nothing, spec, ["doc_id"]).count() == 0
    texts = bpe.decoded(bpe.encoded(odd, spec, ["doc_id"]), spec, ["doc_id"])
    assert texts.count() == odd.count()


@pytest.mark.parametrize("kind,block", [("byte", 1 << 16), ("bit", 100), ("byte", 7)])
def test_plane_files_of_odd_documents(spark, odd, spec, library, tmp_path, kind, block):
    path = str(tmp_path / "ids")
    docs = odd if block > 50 else odd.where("length(text) < 500")
    bitplanes.write_ids(docs, path, spec, block=block, kind=kind)
    got = sorted((tuple(r) for r in bitplanes.read_documents(spark, path).collect()), key=lambda r: r[1])
    ids = {}
    for r in docs.select("doc_id", "text").collect():
        own = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        ids.setdefault(r.doc_id, []).append((len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert [r[0] for r in got] == sorted((k for k, v in ids.items() for _ in v), key=lambda x: (x is not None, x or 0))
    at = 0
    for doc_id, start, n, crc in got:
        assert start == at
        at += n
        assert (n, crc) in ids[doc_id]
    index = spark.read.parquet(path + "/index").collect()
    assert sum(r.n_ids for r in index) == at
    assert all(r.n_ids <= block for r in index)
    every = sorted(tuple(r) for r in bitplanes.read_ids(spark, path, 0, at).collect())
    flat = np.concatenate([np.array(ids) for _, ids in every])
    assert len(flat) == at and [f for f, _ in every] == np.cumsum([0, *(len(ids) for _, ids in every[:-1])]).tolist()
    for a, b in ((0, 1), (at // 3, at // 2), (at - 1, at), (at, at + 5)):
        part = sorted(tuple(r) for r in bitplanes.read_ids(spark, path, a, b).collect())
        assert [i for _, ids in part for i in ids] == flat[a:b].tolist()


def test_plane_files_of_no_documents(spark, nothing, spec, tmp_path):
    bitplanes.write_ids(nothing, str(tmp_path / "ids"), spec)
    assert bitplanes.read_documents(spark, str(tmp_path / "ids")).count() == 0


def test_queries_cover_all_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    four = {r.doc_id: r.n_tokens for r in queries.QUERIES["op4_bpe"](spark, sf).collect()}
    seven = {r.doc_id: r.n_tokens for r in queries.QUERIES["op7_bit_planes"](spark, sf).collect()}
    assert len(four) == len(seven) == docs
    assert all(seven[i] == n + 1 for i, n in four.items())
