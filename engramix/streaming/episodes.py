"""Streams over the append-only episode log and the access log.

Extensions of the batch operators; windows and late data have no counterpart in the
batch model and are marked as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def access_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """The access log as a stream of files; event time as an instant."""
    raw = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.parquet").parquet(folder)
    return raw.withColumn("created_at", F.col("ts").cast("timestamp")).withColumnRenamed("user_id", "session_id")


def fatigue_counts(events: DataFrame, delay: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Retrievals per session and window, with late events accepted for ``delay`` (an extension:
    the batch count has no window)."""
    return (
        events.filter("event_type = 'view'")
        .withWatermark("created_at", delay)
        .groupBy(F.window("created_at", window), "session_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("window_start"), "session_id", "n")
    )


def ingest(episodes: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Append a stream of episodes batch by batch, each id once: a replayed batch gives the same rows,
    and ``sink`` overwrites by batch."""

    def write(batch: DataFrame, number: int) -> None:
        sink(batch.dropDuplicates(["episode_id"]).withColumn("batch", F.lit(number)))

    return episodes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def work_queue(queue: DataFrame, handle: Callable[[DataFrame], None], limit: int, checkpoint: str) -> StreamingQuery:
    """The index queue's worker: of each micro-batch, up to ``limit`` open rows by priority and age."""
    from ..operators.mutations import claim

    def work(batch: DataFrame, _: int) -> None:
        handle(claim(batch, limit))

    return queue.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
