"""Queries of this subpackage over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlens.llm import bands, bitplanes, bpe, chat, decontaminate, importance, langid, licenses, lm, merkle, neardup, repeats, whitening
from rosterlens.llm import words as W
from rosterlens.session import drop_at_end, shared_folder, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    W.lean_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2).alias("held_out")
    )
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    protos = langid.prototypes(docs.where("not held_out"))
    return langid.identify(docs, protos, ["doc_id", "held_out"])


def tokenizer(spark: SparkSession):
    """The 49k word-end vocabulary's file, as a broadcast."""
    import public_tokenizers

    return bpe.load(spark, public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by backtracking, and the text they decode to."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer(spark), ["doc_id"])


@query
def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to plane files and read back."""
    path = f"{shared_folder(spark)}/planes-{uuid.uuid4().hex}"
    bitplanes.write_ids(table(spark, sf_dir, "documents"), path, tokenizer(spark))
    drop_at_end(spark, path)
    return bitplanes.read_documents(spark, path)


@query
def op8_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the compression verdict of every document."""
    return bands.judged(table(spark, sf_dir, "documents"), ["doc_id"])


def sampled_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep``, n_features, log_weight, key and kept of every document; the target is labelled good.

    Null and empty texts have no feature and are never kept.
    """
    good = importance.bounded_target(labels.where("quality = 1").select("doc_id"))
    marked = docs.select("doc_id", "text", *keep).join(F.broadcast(good.withColumn("target", F.lit(True))), "doc_id", "left")
    ratios = importance.log_ratios(marked)
    weights = staged(importance.weighted(marked, ratios, ["doc_id", *keep, "target"]))
    k = importance.room(weights)
    return importance.resampled(weights, k).select("doc_id", *keep, "n_features", "log_weight", "key", "kept")


@query
def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's importance weight, and which a Gumbel top-k keeps."""
    return sampled_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place where a document holds a benchmark item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under a bigram model of six sevenths of them, and under add-one word counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", lm.held_out("doc_id", 7).alias("held_out"))
    model = lm.train(docs.where("not held_out"))
    return lm.score(docs, model, ["doc_id", "held_out"])


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a folder for each source, in it one for 1,000 and one for 50 neighbouring ids."""
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), part(1000), part(50), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence: its own, or that of the nearest folder above."""
    return licenses.licenses(document_files(table(spark, sf_dir, "documents")), ["doc_id"])


@query
def op6_chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recovered from the raw transcripts of all conversations, by a model of three quarters of them."""
    raw = chat.as_transcript(table(spark, sf_dir, "conversations"))
    model = chat.fit(chat.labelled_lines(raw.where(~chat.held_out("conv_id"))))
    return chat.parsed(raw.drop("role"), model)


@query
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding, with the error of their covariance."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place under one root, and what its proof says once some texts were tampered with."""
    made = merkle.manifest(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


@query
def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words that a window of 20 repeats from an earlier place."""
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _framed_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(parts)})"


#: crc32 of a decimal number, bit by bit.
_CRC_SQL = """xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT),
  lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, i: xor(b >> 1, 3988292384 * (b & 1)))), 4294967295)"""

#: Trees by recursion over levels; every leaf then climbs its source's tree and that of the sources.
SQL["op12_merkle_manifest"] = f"""
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (
    SELECT doc_id, source, {_framed_sql("text")} AS leaf, crc32_of AS c,
      CASE WHEN crc32_of % 5 = 0 THEN {_framed_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS bad
    FROM (SELECT *, {_CRC_SQL} AS crc32_of FROM documents))),
t(lvl, source, pos, h) AS (
  SELECT 0, source, pos, leaf FROM d
  UNION ALL
  SELECT lvl + 1, source, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM t) WHERE n > 1 GROUP BY lvl, source, pos // 16),
s AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
  FROM (SELECT source, arg_max(h, lvl) AS h FROM t GROUP BY source)),
u(lvl, pos, h) AS (
  SELECT 0, pos, subroot FROM s
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER () AS n FROM u) WHERE n > 1 GROUP BY lvl, pos // 16),
r AS (SELECT arg_max(h, lvl) AS root FROM u),
g AS (  -- runs of both trees; the upper one's levels stand behind those of its sources
  SELECT 0 AS part, lvl, source, pos // 16 AS run, list(h ORDER BY pos) AS hs FROM t
  WHERE (coalesce(source, ''), source IS NULL, lvl) NOT IN (SELECT coalesce(source, ''), source IS NULL, max(lvl) FROM t GROUP BY source)
  GROUP BY ALL
  UNION ALL
  SELECT 1, lvl, NULL, pos // 16, list(h ORDER BY pos) FROM u WHERE lvl < (SELECT max(lvl) FROM u) GROUP BY ALL),
f(doc_id, source, leaf, part, lvl, pos, acc, proof) AS (
  SELECT doc_id, source, leaf, 0, 0, pos, coalesce(bad, leaf), '' FROM d
  UNION ALL
  SELECT f.doc_id, f.source, f.leaf,
    CASE WHEN g.hs IS NULL THEN f.part + 1 ELSE f.part END, CASE WHEN g.hs IS NULL THEN 0 ELSE f.lvl + 1 END,
    CASE WHEN g.hs IS NULL THEN s.pos ELSE f.pos // 16 END,
    CASE WHEN g.hs IS NULL THEN acc ELSE sha256(array_to_string(hs[:f.pos % 16], '') || acc || array_to_string(hs[f.pos % 16 + 2:], '')) END,
    CASE WHEN g.hs IS NULL THEN proof ELSE proof || array_to_string(hs[:f.pos % 16], '') || array_to_string(hs[f.pos % 16 + 2:], '') END
  FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source
  LEFT JOIN g ON g.part = f.part AND g.lvl = f.lvl AND g.run = f.pos // 16 AND (f.part = 1 OR g.source IS NOT DISTINCT FROM f.source)
  WHERE f.part < 2)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM f JOIN s ON s.source IS NOT DISTINCT FROM f.source, r WHERE f.part = 2
"""


#: All windows, each but the first of its words marked, and the words they cover taken out.
SQL["op13_repeated_passages"] = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM w, unnest(range(1, len(ws) - 18)) AS t(i)),
m AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM m WHERE nth > 1),
o AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT o.doc_id, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY o.p) FILTER (c.p IS NULL) AS kept
      FROM o LEFT JOIN c ON c.doc_id = o.doc_id AND c.p = o.p GROUP BY o.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


#: All pairs that share a shingle, and the closure of the links: the same result by plain counting.
SQL["op9_minhash_near_dedup"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM g),
s AS (SELECT doc_id, unnest(sh) AS v FROM g),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.y FROM r JOIN e ON r.reach = e.x),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON node = doc_id
"""
