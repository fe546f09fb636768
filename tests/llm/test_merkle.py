"""Merkle manifest against trees built one by one."""

import hashlib
import zlib

import pytest

from rosterlens.llm import merkle, queries

NAMES = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels(digests, arity):
    out = [digests]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + arity]) for k in range(0, len(out[-1]), arity)])
    return out


def brute(rows, arity=16):
    groups = {}
    for i, source, lang, n_chars, text in rows:
        leaf = framed((i, source, lang, n_chars, text))
        touched = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        bad = framed((i, source, lang, n_chars, lowered(text))) if touched else leaf
        groups.setdefault(source, []).append((i is not None, i or 0, leaf, i, bad))
    trees = {s: levels([x[2] for x in sorted(g)], arity) for s, g in groups.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in order], arity)
    out = []
    for source, group in groups.items():
        for at, (_, _, leaf, i, bad) in enumerate(sorted(group)):
            proof, acc = "", bad
            for tree, place in ((trees[source], at), (top, order.index(source))):
                for row in tree[:-1]:
                    run, slot = row[place // arity * arity :][:arity], place % arity
                    proof += "".join(run[:slot] + run[slot + 1 :])
                    acc = h(*run[:slot], acc, *run[slot + 1 :])
                    place //= arity
            out.append((i, leaf, trees[source][-1][0], top[-1][0], proof, bad, acc, acc == top[-1][0]))
    return sorted(out, key=str)


def found(docs, **more):
    out = merkle.manifest(docs, **more)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof", "tampered", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("arity", [2, 3, 16])
def test_odd_documents(odd, nothing, arity):
    rows = [tuple(r) for r in odd.select(*NAMES).collect()]
    assert found(odd, arity=arity) == brute(rows, arity)
    assert found(nothing, arity=arity) == []


def test_sources_of_all_sizes(spark):
    """Null and empty sources, one leaf, whole runs and one more, more sources than a run, a third of all rows in one."""
    rows, i = [], 0
    sizes = {None: 5, "": 1, "é": 16, "z": 17, "hot": 400, **{f"s{k}": 1 + k % 3 for k in range(300)}}
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((i * 7 % 1201, source, None if i % 11 else "en", i if i % 5 else None, f"Text {i} Ünï" if i % 13 else None))
            i += 1
    rows += rows[:20]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(7)
    got = found(docs)
    assert got == brute(rows)
    assert {r[-1] for r in got} == {True, False}


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select(*NAMES).collect()]
    want = [(*r[:4], hashlib.sha256(r[4].encode()).hexdigest(), *r[6:]) for r in brute(rows)]
    got = queries.QUERIES["op12_merkle_manifest"](spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
