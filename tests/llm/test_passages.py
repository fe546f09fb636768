"""Benchmark leaks, licences, chat transcripts and the pipeline."""

import random

import pytest
import textwrap

import corpus_pipeline
from pyspark.sql import functions as F

from rosterlens.llm import chat, decontaminate, licenses, queries

ITEMS = [(1, "The stone river walks over seven quick houses near the blue tree, and nobody knows why it went."), (2, None), (3, ""), (4, "short"), (5, "It is 12 o'clock in the town of Üblingen; the bells of the old church ring twelve times today.")]


def edited(text, n, r):
    out = list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        out[i : i + r.choice([0, 1])] = r.choice(["", "q", "zz"]) or out[i]
    return "".join(out)


def test_leaks(spark, odd, nothing):
    r = random.Random(2)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(100, "before " + ITEMS[0][1] + " after"), (101, "x " + ITEMS[4][1].upper() + " y " + ITEMS[0][1]), (102, ITEMS[0][1][:50])]
    rows += [(200 + i, "lead " * i + edited(ITEMS[0][1], 2, r) + " trail" * i) for i in range(20)]
    rows += [(300, "seven quick houses near"), (302, "shortly"), (303, "in short: no"), (301, ITEMS[0][1].replace("o", "ooo").replace("e", "eee"))]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = decontaminate.leaks(docs, items).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(100, 1), (101, 1), (101, 5), (303, 4), *((200 + i, 1) for i in range(20))}
    exact = next(x for x in got if x.doc_id == 100)
    assert rows[0][1][exact.start : exact.stop] == ITEMS[0][1].rstrip(".")
    parts = decontaminate.leaks(docs, items, part=40).collect()
    assert sorted(map(tuple, parts)) == sorted(map(tuple, got))
    assert decontaminate.leaks(nothing, items).count() == 0
    assert decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_leaks_cut_at_an_edge_of_their_document(spark):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    item = ITEMS[0][1].rstrip(".")
    texts = ["words of another document stand here", *(item[n:] for n in range(6)), *(item[: len(item) - n] for n in range(1, 6)), "and the last one"]
    rows = [(i, texts[i % len(texts)]) for i in range(3 * len(texts))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {n: {tuple(r) for r in decontaminate.leaks(docs.repartition(n), items).collect()} for n in (1, 2, 100)}
    assert {r[0] for r in got[1]} == {i for i, t in rows if t in item}
    symbols = lambda t: len(decontaminate.folded(t)[0])
    assert all(0 <= start < stop <= len(rows[i][1]) and edits == symbols(item) - symbols(rows[i][1]) for i, _, start, stop, edits in got[1])
    assert got[1] == got[2] == got[100]


def test_short_items_are_found_between_borders(spark):
    items = spark.createDataFrame([(1, "Short"), (2, "a-b!"), (3, "12 é"), (4, "elevenchars"), (5, "short"), (6, " ... "), (7, "x\0y")], "item_id long, text string")
    rows = [
        (1, "a SHORT one"), (2, "shorter shorts unshort"), (3, "short"), (4, "an A, B."), (5, "112 é"), (6, "so 12...É?"), (7, "(elevenchars)"),
        (8, "x y"), (9, None), (10, ""), (11, "short short"), (12, "xy"), (13, "ab"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = [(1, 1, 2, 7), (1, 5, 2, 7), (3, 1, 0, 5), (3, 5, 0, 5), (4, 2, 3, 7), (6, 3, 3, 9), (7, 4, 1, 12), (8, 7, 0, 3)]
    want += [(11, i, a, a + 5) for i in (1, 5) for a in (0, 6)]
    for n in (1, 4):
        got = decontaminate.leaks(docs.repartition(n), items)
        assert sorted((r.doc_id, r.item_id, r.start, r.stop) for r in got.collect()) == sorted(want)
        assert got.where("edits > 0").isEmpty()


def test_periodic_texts_hold_counts_and_not_hits(monkeypatch):
    """All shared q-grams at once and a few at a time give the same bands; a long periodic text stays small."""
    import tracemalloc

    import numpy as np

    item = "abc de " * 80
    known = decontaminate.Items([1, 2], [item, "a line of its own that stands in no other text at all"])
    codes, _ = decontaminate.folded("xx " + "abc de " * 300 + "end\0" + "a line of its own that stands in no other text at all\0")
    begins = np.append(0, np.flatnonzero(codes == 0)[:-1] + 1)
    every = set(known.regions(codes, begins))
    assert every
    monkeypatch.setattr(decontaminate, "HITS", 1000)
    assert set(known.regions(codes, begins)) == every
    monkeypatch.setattr(decontaminate, "HITS", 1 << 19)
    long, _ = decontaminate.folded("abc de " * 20_000 + "\0")
    tracemalloc.start()
    found = sum(1 for _ in known.regions(long, np.zeros(1, np.int64)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found > 1000
    assert peak < 400 << 20


def test_aligned_is_the_edit_distance():
    r = random.Random(4)
    codes = lambda s: decontaminate.folded(s)[0]

    def distance(item, text):  # of the item to its best place in the text
        row = [0] * (len(text) + 1)
        for i, a in enumerate(item):
            new = [i + 1]
            for j, b in enumerate(text):
                new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    for _ in range(60):
        item = "".join(r.choice("abcd") for _ in range(30))
        text = "".join(r.choice("abcd") for _ in range(r.randrange(8))) + edited(item, r.randrange(5), r) + "cdab"
        want = distance(item, text)
        got = decontaminate.aligned(codes(item), codes(text), 0, 12, 6)
        assert got is None if want > 6 else got[0] == want


def test_given_leaks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d.doc_id, b.item_id) for d in docs for b in items if b.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op5_benchmark_leaks"](spark, sf).collect()}
    assert want <= got


def test_licences(spark, nothing):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "plain words"), (3, "a/b/c/y.txt", None),
        (4, "a/b/c/z.txt", "first lines of a program\nLicensed under the Apache License, Version 2.0.\n" + "and all that it does then " * 9), (5, "q/r.txt", "words"),
        (6, "a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), (7, "a/b/c/d/e.txt", "w"),
        (8, None, "All rights reserved."), (9, "deep/er/f.txt", "nothing"), (9, "deep/er/f.txt", "nothing"), (10, "", ""),
        (11, "a/b2/x.txt", "we need no license to walk in the park by the river today"),
    ]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("dir", F.lit(1)).withColumn("license", F.lit("x"))
    got = sorted((r.doc_id, r.license, r.origin, r.origin_dir) for r in licenses.licenses(files, ["doc_id"]).where("doc_id not in (9, 10, 5)").collect())
    assert got == [
        (1, "MIT", "file", None), (2, "MIT", "inherited", "a"), (3, "GPL-3.0", "inherited", "a/b/c"), (4, "Apache-2.0", "header", None),
        (6, "GPL-3.0", "file", None), (7, "GPL-3.0", "inherited", "a/b/c"), (8, "Proprietary", "file", None), (11, "MIT", "inherited", "a"),
    ]
    rest = licenses.licenses(files, ["doc_id"]).where("doc_id in (9, 10, 5)").collect()
    assert [(r.license, r.origin_dir) for r in rest] == [("Proprietary", "")] * 4  # the file without path lies in the root
    assert licenses.licenses(nothing.withColumn("path", F.lit("p")), ["doc_id"]).count() == 0


def test_wrapped_headers(spark):
    more = {
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\n"
        "file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
        "the Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
        "AGPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as\n"
        "published by the Free Software Foundation, either version 3 of the\nLicense, or (at your option) any later version.",
    }
    wrap = lambda t, n: "\n".join(f"# {x}" for x in textwrap.wrap(t, n, break_on_hyphens=False))
    texts = [(name, wrap(t, n)) for name, t in licenses.TEMPLATES for n in range(50, 81, 3)] + list(more.items())
    rows = [(i, f"{i}.c", f"int main() of a program that counts its words\n{t}\nand more of what it does, then some\n" + "and all of it then\n" * 9) for i, (_, t) in enumerate(texts)]
    found = licenses.scanned(spark.createDataFrame(rows, "doc_id long, path string, text string"), ["doc_id"]).collect()
    assert {r.doc_id: r.license for r in found} == {i: name for i, (name, _) in enumerate(texts)}


def test_templates_find_themselves():
    index = licenses.Index()
    for name, text in licenses.TEMPLATES:
        assert index.best(text)[0] == 1.0, name
        assert any(c in text.lower().encode() for c in licenses.CUES) or index.best(text)[1] == name


def test_chat_roles_and_pieces(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    raw = chat.as_transcript(turns)
    model = chat.fit(chat.labelled_lines(raw))
    one = sorted(map(tuple, chat.parsed(raw.drop("role"), model).collect()))
    two = sorted(map(tuple, chat.parsed(raw.drop("role").repartition(5), model, piece=3).collect()))
    assert one == two
    given = turns.orderBy("conv_id", "turn").collect()
    by_conv = {}
    for r in given:
        by_conv.setdefault(r.conv_id, []).append(r.role)
    found = {}
    for conv, _, role, *_ in one:
        found.setdefault(conv, []).append(role)
    assert sum(found[c] == roles for c, roles in by_conv.items()) >= 0.97 * len(by_conv)


def test_roles_of_conversations_the_model_never_saw(spark):
    turns = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    raw = chat.as_transcript(turns)
    model = chat.fit(chat.labelled_lines(raw.where(~chat.held_out("conv_id"))))
    unseen = raw.where(chat.held_out("conv_id"))
    want, got = {}, {}
    for r in unseen.orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append(r.role)
    for conv, _, role, *_ in sorted(map(tuple, chat.parsed(unseen.drop("role"), model).collect())):
        got.setdefault(conv, []).append(role)
    assert len(want) > 100
    assert sum(got[c] == roles for c, roles in want.items()) >= 0.95 * len(want)


def test_every_turn_of_a_long_conversation_teaches(spark):
    """Blocks of 64, gaps in the numbering, and a first turn that is not numbered 0."""
    r = random.Random(3)
    rows = [(c, 5 + 3 * t + 400 * (t > 90), r.choice(["user", "assistant"]), "\n".join("ab" for _ in range(r.randrange(1, 4)))) for c in (1, None) for t in range(200)]
    raw = chat.as_transcript(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7))
    lines = chat.labelled_lines(raw).collect()
    firsts = [x for x in lines if x["first"]]
    assert len(firsts) == 400
    assert sum(x["before"] is None for x in firsts) == 2
    assert sum(x["before_state"] is None for x in firsts) == 2
    assert len(lines) == sum(x.text.count("\n") + 1 for x in raw.collect())


def test_best_path_is_the_best_of_all(spark):
    """Viterbi against every path of short transcripts."""
    import itertools

    import numpy as np

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    model = chat.fit(chat.labelled_lines(chat.as_transcript(turns)))
    r = random.Random(5)
    for _ in range(12):
        lines = [r.choice(["User: hi?", "Assistant: ok", "", "plain words here", "### Response:", "System: x"]) for _ in range(4)]
        seen = np.array([chat.observed(x, y) for x, y in zip(lines, [None, *lines[:-1]], strict=True)])
        emit = np.stack([sum(table[:, v] for table, v in zip(model.emit, row, strict=True)) for row in seen])
        score = lambda p: model.start[p[0]] + sum(model.move[a, b] for a, b in itertools.pairwise(p)) + sum(emit[i, s] for i, s in enumerate(p))
        best = max(score(p) for p in itertools.product(range(chat.STATES), repeat=len(lines)))
        assert score(chat.best_path(model, seen).tolist()) == pytest.approx(best)


def test_odd_chats(spark):
    kind = "conv_id long, turn long, role string, text string, place long"
    rows = [(1, 0, "user", None, 1), (1, 1, "assistant", "", 1), (None, 0, "user", "hi", 1), (None, None, None, "x", 1), (2, 0, "robot", "a: b\nUser: c", 1), (2, 0, "robot", "a: b\nUser: c", 1)]
    raw = chat.as_transcript(spark.createDataFrame(rows, kind))
    model = chat.fit(chat.labelled_lines(raw))
    got = chat.parsed(raw.drop("role"), model).collect()
    assert {r.conv_id for r in got} == {1, 2, None}
    nothing = chat.as_transcript(spark.createDataFrame([], kind))
    assert chat.parsed(nothing, chat.fit(chat.labelled_lines(nothing))).count() == 0


def test_pipeline_stages(spark, odd, nothing, sf):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert stage(spark, nothing, sf).count() == 0
        if name != "tokens":
            assert out.columns == docs.columns
            docs = out
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    left = {r.doc_id for r in out.collect()}
    assert left
    assert not {1, 2, 3, 4, 8, 9} & left


def test_pipeline_without_and_with_repeated_doc_ids(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["text"])
    given = docs.collect()
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    clean = [r.text for r in given if labels.get(r.doc_id) == 1 and len(r.text) > 500][:8]
    rows = [(i, f"{t} {j}") for j, t in enumerate(clean) for i in (None, 7)]
    bad = [(None, f"{clean[0]} {leak} one"), (7, f"{clean[1]} {leak} two")]
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    left = corpus_pipeline.decontamination(spark, make(rows + bad), sf).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(str(r) for r in rows if leak not in r[1])
    words = [" ".join(f"{chr(97 + i)}{j}" for j in range(40)) for i in range(4)]
    many = [(None, words[0]), (None, words[0]), (3, words[0]), (5, words[1]), (5, words[1]), (5, words[2]), (None, words[3]), (None, words[3]), (None, ""), (None, "")]
    left = corpus_pipeline.near_duplicates(spark, make(many), sf).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(3, words[0]), (5, words[1]), (5, words[2]), (None, words[3]), (None, "")]))
    # quality: what the operator says of each text by itself
    mixed = docs.select(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("doc_id"), "text")
    judged = {(r.doc_id, r.digest): r.kept for r in queries.sampled_quality(corpus_pipeline.keyed(mixed), spark.read.parquet(f"{sf}/labels.parquet"), ("digest",)).collect()}
    left = {(r.doc_id, r.digest) for r in corpus_pipeline.keyed(corpus_pipeline.quality(spark, mixed, sf)).collect()}
    assert left == {x for x, kept in judged.items() if kept}
    assert {kept for (i, _), kept in judged.items() if i is None} == {True, False}


def test_pipeline_over_the_given_documents(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in rows}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert ids < set(docs)
    assert not any(b in docs[i] for i in ids for b in items)
    assert len({docs[i] for i in ids}) == len(ids)
