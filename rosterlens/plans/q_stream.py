"""Queries on the event stream, run as streams over the given table and in batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rosterlens.plans.q_cells import rounded
from rosterlens.plans.registry import query
from rosterlens.session import drop_at_end, shared_folder
from rosterlens.sources import tables as T
from rosterlens.streaming import ingest as S

W = """e AS (SELECT ts, user_id AS model_id, (value > 10)::INT AS c FROM events)"""


def answers(spark, sf):
    return S.event_answers(T.table(spark, sf, "events"))


@query(
    "window_tumbling",
    f"""WITH {W} SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS "end", model_id, count(*) AS answered, round(avg(c), 6) AS accuracy FROM e GROUP BY ALL""",
)
def window_tumbling(spark, sf):
    """Daily answers and accuracy per model."""
    return rounded(S.windowed_accuracy(answers(spark, sf)), "accuracy")


@query(
    "window_sliding",
    f"""WITH {W}, b AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS tb FROM e), x AS (SELECT tb - (i * INTERVAL 6 HOUR) AS start, model_id, c FROM b, range(4) r(i))
    SELECT start, start + INTERVAL 1 DAY AS "end", model_id, count(*) AS answered, round(avg(c), 6) AS accuracy FROM x GROUP BY ALL""",
)
def window_sliding(spark, sf):
    """One-day windows every six hours."""
    return rounded(S.windowed_accuracy(answers(spark, sf), "1 day", "6 hours"), "accuracy")


@query(
    "window_session",
    f"""WITH {W}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY model_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM e),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY model_id ORDER BY ts, brk DESC ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", model_id, count(*) AS answered, round(avg(c), 6) AS accuracy FROM s GROUP BY model_id, sid""",
)
def window_session(spark, sf):
    """Sessions of a model, closed by 30 idle minutes."""
    return rounded(S.session_accuracy(answers(spark, sf)), "accuracy")


def scratch(spark) -> str:
    """A new folder in the folder that driver and executors share; it goes when the application ends."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    drop_at_end(spark, path)
    return path


@query(
    "stream_windows",
    f"""WITH {W} SELECT date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS "end", model_id, count(*) AS answered, round(avg(c), 6) AS accuracy FROM e GROUP BY ALL""",
)
def stream_windows(spark, sf):
    """The daily windows computed by a stream over the event file; equal to the batch form."""
    schema = T.table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    out = S.windowed_accuracy(S.event_answers(source))
    folder = scratch(spark)
    # complete mode keeps every window, also those the watermark has not closed yet
    q = (
        out.writeStream.outputMode("complete").trigger(availableNow=True)
        .option("checkpointLocation", folder + "/state")
        .foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(folder + "/table"))
        .start()
    )
    q.awaitTermination()
    out = spark.read.parquet(folder + "/table")
    local = {c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}
    return rounded(out.withColumns(local), "accuracy")


@query(
    "stream_ingest",
    """SELECT user_id::VARCHAR AS model_id, event_type AS question_id, arg_max((value > 10)::INT, event_id) AS correct, max(event_id) AS seq FROM events GROUP BY 1, 2""",
)
def stream_ingest(spark, sf):
    """Graded rows ingested as a stream; of several rows for a cell the last one stays."""
    schema = T.table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = source.select(
        F.col("user_id").cast("string").alias("model_id"), F.col("event_type").alias("question_id"),
        (F.col("value") > 10).cast("int").alias("correct"), F.col("event_id").alias("seq"),
    )
    folder = scratch(spark)
    S.ingest(rows, folder + "/table", folder + "/state").awaitTermination()
    return S.read_merged(spark, folder + "/table")
