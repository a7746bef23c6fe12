"""Batch operators over streams: documents arrive in micro-batches, events in sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def per_batch(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a document operator on each micro-batch and write what it gives under the batch's number.

    A batch that is tried again overwrites its own folder, so each result is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session, n, value): runs of a user's events without a gap; events up to `late` behind still count."""
    found = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("session"))
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path)
