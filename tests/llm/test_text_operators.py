"""Language, quality, compression and language-model operators."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rosterlens.llm import bands, importance, langid, lm, queries


def test_languages_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op10_language_id"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_languages_of_odd_documents(odd, nothing):
    protos = langid.prototypes(odd)
    rows = langid.identify(odd, protos, ["doc_id"]).collect()
    assert len(rows) == odd.count()
    assert {r.doc_id for r in rows if r.lang_pred == "und" and r.doc_id} == {1, 2, 3, 4}
    assert langid.prototypes(nothing) == {}
    assert {r.lang_pred for r in langid.identify(odd, {}, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(nothing, protos, ["doc_id"]).count() == 0


def test_gram_vectors_are_bound_rotated_letters():
    v = langid.GramVectors(64, 3)
    a, b, c = (v.symbol(ord(x)) for x in "abc")
    gram, counts = langid.gram_counts(np.array([97, 98, 99]), 3)
    assert counts.tolist() == [1]
    assert (v.bound(int(gram[0])) == np.roll(a, 2) * np.roll(b, 1) * c).all()
    small = langid.GramVectors(256, 3, held=9)
    texts = ["abcabd xyz", "the cat and the dog", None, "éa"]
    whole, some = langid.bundles(texts, langid.GramVectors(256, 3))
    assert np.allclose(langid.bundles(texts, small)[0], whole, atol=1e-5)
    assert some.tolist() == [True, True, False, True]


def slow_bands(text):
    words = (text or "").encode().split()
    chars = [w.decode() for w in words]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {j for i in range(len(words) - 2) if grams[words[i], words[i + 1], words[i + 2]] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if x.encode().split():
            dup += x in lines
            lines.add(x)
    return len(words), sum(map(len, chars)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_bands_of_odd_documents(odd, nothing):
    rows = bands.judged(odd.withColumn("copy", F.col("text")), ["doc_id", "copy"])
    for r in rows.collect():
        n, chars, symbols, dup, repeat = slow_bands(r.copy)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.kept and r.base_failed)
    assert bands.judged(nothing, ["doc_id"]).count() == 0


def test_bands_reject_repetition_and_noise(spark, sf):
    import zstandard

    pack = zstandard.ZstdCompressor(level=3)
    r = random.Random(5)
    noise = bytes(r.randrange(33, 127) for _ in range(5000))
    assert not bands.compression(noise, pack)[2]
    assert not bands.compression(b"the same line again\n" * 400, pack)[2]
    assert bands.chunks(b"x" * 5000, 2048)[-1] == b"x" * (5000 - 2048)
    docs = spark.read.parquet(f"{sf}/labels.parquet").join(queries.QUERIES["op8_compression_bands"](spark, sf), "doc_id")
    good = docs.where("quality = 1 and n_words >= 50").select("kept", "base_failed").collect()
    assert sum(x.kept for x in good) >= 0.99 * sum(not x.base_failed for x in good)


@pytest.mark.parametrize("k", [1, 2, 500, 999, 1000, 1001])
def test_the_kth_largest(spark, k):
    r = random.Random(1)
    values = [r.choice([r.uniform(-9, 9), r.uniform(-1e9, 1e9), 0.5]) for _ in range(1000)]
    ranks = spark.createDataFrame([(v,) for v in values], "x double").select(importance.ordered(F.col("x")).alias("rank"))
    want = sorted((x.rank for x in ranks.collect()), reverse=True)
    assert importance.cut_at(ranks, k) == (want[k - 1] if k <= 1000 else None)


def test_resampling_draws_in_proportion(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, math.log(3)).otherwise(0.0).alias("log_weight"))
    got = importance.resampled(rows, 400).where("kept").collect()
    assert len(got) == 400
    assert 0.65 < sum(r.doc_id % 2 == 0 for r in got) / 400 < 0.85  # 3 to 1
    assert importance.resampled(rows, 0).where("kept").count() == 0
    assert importance.bounded_target(rows, 1000).count() < 1300
    assert importance.bounded_target(rows.unionByName(rows), 20_000).count() == 20_000


def test_quality_of_given_and_odd_documents(spark, odd, nothing):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES["op3_importance_resampling"](spark, sf).join(labels, "doc_id").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good)
    assert sum(bad) <= 0.2 * len(bad)
    assert queries.sampled_quality(odd, labels).count() == odd.count()
    assert queries.sampled_quality(odd, labels.limit(0)).where("kept").count() > 0
    assert queries.sampled_quality(nothing, labels).count() == 0


def test_empty_texts_take_no_place(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    text = F.when(F.col("id") % 3 == 0, F.lit("")).when(F.col("id") % 3 == 1, F.lit(" \n "))
    empty = spark.range(10**6, 10**6 + docs.count() // 2).select(F.col("id").alias("doc_id"), text.alias("text"))
    alone, beside = ({r.doc_id for r in queries.sampled_quality(d, labels).where("kept").collect()} for d in (docs, docs.unionByName(empty)))
    assert alone and alone == beside


def test_scores_by_brute_force_and_by_both_ways(spark, odd, nothing):
    docs = odd.select("doc_id", "text", "n", lm.held_out("doc_id", 7).alias("held_out"), F.col("text").alias("copy"))
    model = lm.train(docs.where("not held_out"), segment_bytes=50_000)
    assert model.shift < 64
    counts = Counter()
    words = lambda t: [*(t or "").encode().lower().split(), None]
    for r in docs.where("not held_out").collect():
        counts.update(words(r.text))
    total, types = sum(counts.values()), len(counts)
    one = lm.score(docs, model, ["doc_id", "held_out", "copy"]).collect()
    two = lm.score(docs, model, ["doc_id", "held_out", "copy"], broadcast_bytes=0).collect()
    key = lambda r: (str(r.doc_id), str(r.copy))
    assert len(one) == len(two) == docs.count()
    for a, b in zip(sorted(one, key=key), sorted(two, key=key), strict=True):
        w = words(a.copy)
        assert (a.n_tokens, a.n_known, a.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert math.isclose(a.base_score, sum(math.log10((counts[x] + 1) / (total + types + 1)) for x in w), rel_tol=1e-9)
        assert (a.n_known, a.base_score) == (b.n_known, b.base_score)
        assert math.isclose(a.score, b.score, rel_tol=1e-9)
        assert a.score <= 0
    empty = lm.train(nothing)
    assert empty.tokens == 0
    assert lm.score(odd, empty, ["doc_id"]).count() == odd.count()


def test_the_model_beats_word_counts_on_held_out_documents(spark):
    rows = queries.QUERIES["op1_lm_scores"](spark, "/root/testdata/sf0.01").where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_levels_and_filter():
    c = np.array([1, 2, 3, 4, 10, 1000])
    assert lm.levels(c)[0] == 1
    assert (np.abs(lm.values(lm.levels(c)) - c) <= 0.25 * c).all()
    assert lm.values(np.array([0]))[0] == 0


def test_groups_of_documents_ask_once_for_an_ngram(spark, odd, monkeypatch):
    """Many groups give the scores of the broadcast filter; an answer is a byte for each key, and the counts of words."""
    monkeypatch.setattr(lm, "ASKED", 1 << 14)
    docs = odd.select("doc_id", "text")
    model = lm.train(docs, segment_bytes=50_000)
    one, two = (sorted(map(tuple, lm.score(docs, model, ["doc_id"], broadcast_bytes=n).collect()), key=str) for n in (1 << 30, 0))
    assert one == two
    words = np.array([3, 9], np.uint64)
    known = lm.Filter(64, np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint8), words, np.array([70_000, 2]))
    level, exact = lm._answer(known, np.array([1, 3, 5, 9], np.uint64))
    assert list(level) == [0, 128, 0, 128] and lm.widened(exact).tolist() == [70_000, 2]
    assert [len(lm.narrow(np.array(x))) for x in ([], [255], [256, 1], [1 << 32])] == [1, 2, 5, 9]
