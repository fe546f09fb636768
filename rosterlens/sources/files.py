"""File readers and writers of the pipeline: JSON lines in, Parquet, CSV and JSON out.

Readers declare their schema, so nothing is inferred; a malformed required field fails the load.
"""

from __future__ import annotations

import io
import lzma
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE = "id string, axis string, question string, gold string, grader string, format string, n_choices int"
REQUIRED = ("id", "axis", "question", "gold", "grader")
RECORDED = "id string, prediction string"
GRADED = (
    "id string, axis string, correct string, n_tok int, model string, draw_idx int, prediction string, "
    "finish_reason string, config_hash string"
)
BOARD = "model_ids array<string>, tables map<string, struct<scores: map<string, double>, n_published: int, n_matched: int>>"
SURVEY = "metrics map<string, map<string, string>>, model_attributes map<string, map<string, string>>"
CARD = (
    "ok boolean, model_key string, repo_id string, "
    "architecture struct<model_type: string, max_position_embeddings: bigint, hidden_size: bigint, "
    "architectures: array<string>, parameter_dtypes: map<string, bigint>>, "
    "popularity struct<downloads: bigint, likes: bigint>, metadata struct<license: string, tags: array<string>>, "
    "timestamps struct<createdAt: string, lastModified: string>, _bad string"
)
FOOTPRINTS = (
    "models map<string, struct<dir: string, hf_id: string, family: string, params_b: double, quant: string, "
    "serve_quant: string, weight_bytes: bigint, status: string>>"
)


class SourceError(ValueError):
    """A source file breaks its contract."""


def config_hash(draws: Column, max_tokens: Column, model: Column, temperature: Column) -> Column:
    """First 12 hex digits of the SHA-256 of the settings as sorted-key JSON with ", " and ": "."""
    text = F.concat(
        F.lit('{"draws": '), draws.cast("string"),
        F.lit(', "max_tokens": '), max_tokens.cast("string"),
        F.lit(', "model": "'), model,
        F.lit('", "temperature": '), temperature.cast("string"), F.lit("}"),
    )
    return F.substring(F.sha2(text, 256), 1, 12)


def load_probe(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON-lines file; lines end at a line feed only.

    A row without one of the required fields, or whose grader names no routed benchmark, fails.
    """
    from rosterlens.operators.routing import resolve

    df = spark.read.schema(PROBE).option("lineSep", "\n").json(path)
    missing = df.select(*[F.count_if(F.col(c).isNull()).alias(c) for c in REQUIRED]).first()
    bad = {c: missing[c] for c in REQUIRED if missing[c]}
    if bad:
        raise SourceError(f"required fields are missing: {bad}")
    graders = df.select(F.regexp_replace("grader", "^bench:", "").alias("bench"), F.lit("").alias("model")).distinct()
    lost = [r["bench"] for r in resolve(graders, "bench", "model").filter("routed = 0").orderBy("bench").limit(20).collect()]
    if lost:
        raise SourceError(f"graders without a route: {lost}")
    return df


def _file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.jsonl(\.xz)?$", "")


def recorded_responses(spark: SparkSession, folder: str) -> DataFrame:
    """recorded(model_id, id, prediction) of <model>.jsonl and <model>.jsonl.xz; a later duplicate wins.

    Compressed files cannot be split, so each is decoded by one task, in chunks.
    """
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    plain = (
        spark.read.schema(RECORDED).option("pathGlobFilter", "*.jsonl").option("lineSep", "\n").json(folder)
        .select(_file_stem(F.col("_metadata.file_path")).alias("model_id"), "id", "prediction", at.alias("at"))
    )
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl.xz").load(folder)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for path, content in zip(p["path"], p["content"]):
                with lzma.open(io.BytesIO(content), "rt", encoding="utf-8", newline="\n") as f:
                    lines, n = [], 0
                    for line in f:
                        lines.append((path, n, line.rstrip("\n")))
                        n += 1
                        if len(lines) == 10_000:
                            yield pd.DataFrame(lines, columns=["path", "n", "line"])
                            lines = []
                    if lines:
                        yield pd.DataFrame(lines, columns=["path", "n", "line"])

    xz = (
        packed.select("path", "content").mapInPandas(decode, "path string, n bigint, line string")
        .filter(F.trim("line") != "")
        .select(_file_stem(F.col("path")).alias("model_id"), F.from_json("line", RECORDED).alias("r"), F.struct(F.lit(0).cast("bigint"), F.col("n")).alias("at"))
        .select("model_id", "r.id", "r.prediction", "at")
    )
    both = plain.select("model_id", "id", "prediction", F.struct(F.col("at.file_block_start").alias("a"), F.col("at.col2").alias("b")).alias("at")).unionByName(
        xz.select("model_id", "id", "prediction", F.struct(F.col("at.col1").alias("a"), F.col("at.n").alias("b")).alias("at"))
    )
    return both.groupBy("model_id", "id").agg(F.max_by("prediction", "at").alias("prediction"))


def graded_draws(rows: DataFrame) -> DataFrame:
    """draws(model_id, id, axis, correct): ``correct`` may be one grade or a list of draws."""
    listed = F.when(F.startswith(F.trim("correct"), F.lit("[")), F.from_json("correct", "array<int>")).otherwise(
        F.array(F.col("correct").try_cast("int"))
    )
    return rows.select(F.col("model").alias("model_id"), "id", "axis", F.explode(listed).alias("correct"))


def load_results(spark: SparkSession, folder: str) -> DataFrame:
    """Graded rows of <folder>/<model>/results.jsonl; per model and question the last line wins."""
    raw = (
        spark.read.schema(GRADED).option("pathGlobFilter", "results.jsonl").option("recursiveFileLookup", "true").option("lineSep", "\n").json(folder)
    )
    at = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    fields = [c for c in raw.columns if c != "id"]
    kept = raw.withColumn("__m", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)).withColumn("__at", at)
    last = kept.groupBy("__m", "id").agg(F.max_by(F.struct(*fields), "__at").alias("r"))
    return last.select("id", "r.*").withColumn("model", F.coalesce("model", F.lit(None).cast("string")))


def collected_models(spark: SparkSession, folder: str) -> DataFrame:
    """models(model_id) that have a result file, sorted. Only file names are read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "results.jsonl").option("recursiveFileLookup", "true").load(folder).select("path")
    )
    return files.select(F.element_at(F.split("path", "/"), -2).alias("model_id")).distinct().orderBy("model_id")


def write_results(rows: DataFrame, folder: str, order: str) -> None:
    """Graded rows as JSON, one folder per model, in probe order inside and across its files; the commit is atomic.

    Rows are laid out by ranges of model and probe, so a model with very many rows has several files.
    """
    rows.repartitionByRange("model_id", order).sortWithinPartitions("model_id", order).write.mode("overwrite").partitionBy("model_id").json(folder)


def board_labels(spark: SparkSession, path: str) -> DataFrame:
    """labels(board, model_id, value) of a published-board file."""
    raw = spark.read.schema(BOARD).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    return raw.select(F.explode("tables").alias("board", "t")).select("board", F.explode("t.scores").alias("model_id", "value"))


def merge_boards(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two board sources; a table name in both is an error."""
    clash = a.select("board").distinct().join(b.select("board").distinct(), "board", "left_semi").limit(5).collect()
    if clash:
        raise SourceError(f"tables published by both sources: {sorted(r['board'] for r in clash)}")
    return a.unionByName(b)


def survey_board(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(metrics(metric, name, value), attributes(name, attribute, value)); malformed files fail."""
    raw = spark.read.schema(SURVEY).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    m = raw.select(F.explode("metrics").alias("metric", "v")).select("metric", F.explode("v").alias("name", "value"))
    a = raw.select(F.explode("model_attributes").alias("name", "v")).select("name", F.explode("v").alias("attribute", "value"))
    return m, a


def model_cards(spark: SparkSession, folder: str) -> DataFrame:
    """cards(model_key, card) of one JSON file per model; malformed and not-ok cards are missing."""
    raw = (
        spark.read.schema(CARD).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", "true").json(folder)
    )
    stem = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.json$", "")
    return raw.withColumn("file_key", stem).filter(F.col("_bad").isNull() & F.col("ok")).drop("_bad")


def footprints(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(FOOTPRINTS).option("multiLine", "true").json(path)
    return raw.select(F.explode("models").alias("model_id", "e")).select("model_id", "e.*")


def release_dates(spark: SparkSession, path: str, root: str = "models", field: str = "created_at") -> DataFrame:
    """dates(key, date) of {root: {key: entry}}; an entry is an object with the field, or a bare string."""
    from rosterlens.functions.scalars import iso_date

    raw = spark.read.schema(f"{root} map<string, string>").option("multiLine", "true").json(path)
    e = raw.select(F.explode(root).alias("key", "e"))
    value = F.coalesce(F.get_json_object("e", f"$.{field}"), F.when(~F.startswith("e", F.lit("{")), F.col("e")))
    return e.select("key", iso_date(value).alias("date"))


def alias_map(spark: SparkSession, path: str) -> DataFrame:
    """aliases(published, model, pos)."""
    raw = spark.read.schema("aliases map<string, string>").option("multiLine", "true").json(path)
    return raw.select(F.posexplode("aliases").alias("pos", "published", "model"))


def write_csv(df: DataFrame, folder: str) -> None:
    """A result table as CSV with its header; an empty table still writes one."""
    out = df if df.take(1) else df.coalesce(1)
    out.write.mode("overwrite").option("header", "true").csv(folder)


def write_table(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(folder)


def read_plan(spark: SparkSession, folder: str, models: DataFrame) -> DataFrame:
    """A stored fold plan; a model on one side only is an error."""
    plan = spark.read.parquet(folder)
    stray = plan.join(models, "model_id", "left_anti").select("model_id").unionByName(
        models.join(plan, "model_id", "left_anti").select("model_id")
    )
    found = stray.limit(5).collect()
    if found:
        raise SourceError(f"plan and model axis disagree on {[r['model_id'] for r in found]}")
    return plan


def question_table(spark: SparkSession, folder: str, questions: DataFrame, width: int) -> DataFrame:
    """A stored question-vector table for the asked questions; a missing id or a wrong width is an error."""
    bank = spark.read.parquet(folder)
    lost = questions.join(bank, "question_id", "left_anti").limit(5).collect()
    if lost:
        raise SourceError(f"questions without a vector: {[r['question_id'] for r in lost]}")
    size = F.size("emb")
    checked = F.when(size == width, F.col("emb")).otherwise(
        F.raise_error(F.concat(F.lit("vector of width "), size.cast("string"))).cast("array<float>")
    )
    return bank.join(questions.select("question_id"), "question_id").withColumn("emb", checked)
