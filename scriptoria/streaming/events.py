"""Streams of files and events; each function takes a static or a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def book_stream(spark: SparkSession, path: str, schema, most_files: int = 100) -> DataFrame:
    """New JSON books of a folder, as they come."""
    return spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", most_files).json(path)


def ingest(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the stream to a Parquet table; a restart continues from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return _windowed(events, F.window("ts", width), late)


def sliding(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return _windowed(events, F.window("ts", width, slide), late)


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Streams get a watermark, for which their times must know a time zone: that of the session."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def _windowed(events: DataFrame, window, late: str) -> DataFrame:
    rows = _watermarked(events, late)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = _watermarked(events, late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")
