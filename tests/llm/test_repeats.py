"""Removal of repeated passages against all windows."""

import random

import numpy as np
import pytest

from rosterlens.llm import queries, repeats
from rosterlens.llm import words as W


def brute(rows, width=20):
    """Equal rows are one document; others follow by doc_id, then by what the operator takes as their order."""
    docs = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    seen, marks = set(), {}
    for row in docs:
        words = (row[1] or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        marks[row] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
    return sorted(((r[0], *marks[r]) for r in rows), key=str)


def found(docs, **more):
    out = repeats.without_repeats(docs, **more)
    assert out.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"]
    rows = out.collect()
    for r in rows:
        assert sum(s.length for s in r.spans) == r.n_removed
        assert all(a.start + a.length < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=str)


def ordered(docs):
    return [tuple(r) for r in docs.selectExpr("doc_id", "text", "xxhash64(text)").collect()]


@pytest.mark.parametrize("piece", [300, 1 << 22])
def test_odd_documents(odd, nothing, piece):
    assert found(odd, piece=piece, room=50) == brute(ordered(odd))
    assert found(nothing) == []


def test_cover_meets_every_shift():
    cover = set(repeats.COVER)
    for shift in range(repeats.PERIOD):
        assert any((a + shift) % repeats.PERIOD in cover for a in cover)


@pytest.mark.parametrize("seed", range(3))
def test_passages_that_many_documents_share(spark, seed):
    """Passages of 15 to 60 words at any place, exact and near copies, a third of all rows with one passage."""
    r = random.Random(seed)
    make = lambda n: [r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(n)]
    shared = [make(r.randrange(15, 60)) for _ in range(12)]
    rows = []
    for i in range(240):
        words = make(r.randrange(0, 80))
        for p in r.sample(shared, r.randrange(0, 3)) + ([shared[0]] if i % 3 == 0 else []):
            at = r.randrange(len(words) + 1)
            words[at:at] = p
        rows.append((i * 37 % 240, "\t".join(words)))
    for i, text in rows[:40]:
        words = text.split()
        if words:
            words[r.randrange(len(words))] = "new"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, text) for i, text in rows[40:60]]
    rows += [(5, " ".join(make(90))), (5, " ".join(shared[1] * 3)), rows[3], (None, rows[9][1]), (None, " ".join(shared[2]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want = brute(ordered(docs))
    assert sum(x[2] for x in want) > 2000
    assert found(docs, piece=2000, room=100) == want
    assert found(docs) == want


def test_words_longer_than_the_table_of_places():
    a = bytearray(b"x" * 70_000)
    b = bytearray(a)
    a[10], b[10 + (1 << 16) - 0] = ord("y"), ord("y")
    both = np.frombuffer(bytes(a) + b" " + bytes(b), np.uint8)
    first, second = W.span_hashes(both, *W.spans(both))
    assert first != second


def test_query(spark, sf):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.QUERIES["op13_repeated_passages"](spark, sf)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    want = [(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute(ordered(docs))]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
