"""Answer logs as streams: latest graded row per cell, and running accuracy in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRADED = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("correct", T.IntegerType()),
        T.StructField("seq", T.LongType()),
    ]
)

#: Hash partitions of the merged table; a batch rewrites only those it touches.
BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64("model_id"), F.lit(BUCKETS)).cast("int")


def latest(rows: DataFrame) -> DataFrame:
    """The row with the highest ``seq`` per (model, question)."""
    return rows.groupBy("model_id", "question_id").agg(F.max_by("correct", "seq").alias("correct"), F.max("seq").alias("seq"))


def merge_batch(batch: DataFrame, folder: str) -> None:
    """Fold one micro-batch into the table ``folder``, last row wins.

    A new generation of the touched buckets is written beside the old one and readers take the
    newest row, so a replayed batch changes nothing and a lost executor leaves no torn table.
    """
    latest(batch).withColumn("bucket", _bucket()).write.mode("append").partitionBy("bucket").parquet(folder)


def read_merged(spark: SparkSession, folder: str) -> DataFrame:
    return latest(spark.read.parquet(folder).select("model_id", "question_id", "correct", "seq"))


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Write the merged table once per cell into a new folder."""
    read_merged(spark, folder).withColumn("bucket", _bucket()).repartition("bucket").write.mode("errorifexists").partitionBy(
        "bucket"
    ).parquet(target)


def ingest(source: DataFrame, folder: str, checkpoint: str):
    """Start the ingest of a graded-row stream; returns the streaming query."""
    return (
        source.writeStream.foreachBatch(lambda batch, _: merge_batch(batch, folder))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def event_answers(events: DataFrame) -> DataFrame:
    """Events as graded answers: the user answers, the event type is the question, a high value is correct."""
    return events.select(
        "ts", F.col("user_id").alias("model_id"), F.col("event_type").alias("question_id"), (F.col("value") > 10).cast("int").alias("correct")
    )


def windowed_accuracy(answers: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Answers and accuracy per model in event-time windows; rows later than ``late`` are dropped in a stream."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = answers.withWatermark("ts", late).groupBy(w.alias("w"), "model_id").agg(
        F.count(F.lit(1)).alias("answered"), F.sum("correct").alias("n_correct")
    )
    return out.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "model_id", "answered",
        (F.col("n_correct") / F.col("answered")).alias("accuracy"),
    )


def session_accuracy(answers: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """The same per session of a model: a session ends after ``gap`` without an answer."""
    out = answers.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "model_id").agg(
        F.count(F.lit(1)).alias("answered"), F.sum("correct").alias("n_correct")
    )
    return out.select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "model_id", "answered",
        (F.col("n_correct") / F.col("answered")).alias("accuracy"),
    )
