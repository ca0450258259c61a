"""Spike counts and sessions over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """Files of events as they appear below ``folder``; event time is taken as UTC."""
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("ts", F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums for each window and type; rows later than ``late`` are left out, and state is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Runs of a user's events with no gap as long as ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Write what is there so far to Parquet at ``path``: windows that the watermark has closed, once each."""
    query = df.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
