"""Streaming extension: event-time velocity and session bursts over the events table's schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def velocity(events: DataFrame, late: str = "1 hour", size: str = "1 hour", slide: str = "30 minutes") -> DataFrame:
    """Counts and sums per user and sliding window; rows later than the watermark are dropped in a stream."""
    df = events.withColumn("at", F.col("ts").cast("timestamp"))
    df = df.withWatermark("at", late) if df.isStreaming else df
    out = df.groupBy(F.window("at", size, slide).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.unix_seconds("w.start").alias("window_start"), "user_id", "n", F.round("total", 6).alias("total"))


def bursts(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events no further apart than gap."""
    df = events.withColumn("at", F.col("ts").cast("timestamp"))
    df = df.withWatermark("at", late) if df.isStreaming else df
    out = df.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_seconds("w.start").alias("session_start"), F.unix_seconds("w.end").alias("session_end"), "user_id", "n")
