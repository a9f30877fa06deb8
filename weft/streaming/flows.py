"""Structured Streaming over events: windowed counts with late data, sessions, and micro-batches into sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, files: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream, `files` a batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def timed(events: DataFrame, late: str) -> DataFrame:
    """A stream's event times as timestamps with a watermark; batches as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Events and their values by window and type; state older than `late` goes."""
    rows = timed(events, late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = timed(events, late)
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "total")


def into(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], mode: str = "append"):
    """Runs what there is through foreachBatch and stops; the checkpoint makes a restart go on where it ended."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return query
