"""Polled snapshots as a file stream: each new file is parsed once and its new
events are appended to a staging table. Grouping, declustering and percentiles
stay batch, because a revised event may change them for the past."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quakeloom.sources.bronze import normalise_snapshots, read_snapshots


def new_events(spark: SparkSession, bronze: str, watermark: str = "30 days") -> DataFrame:
    """Events not ingested before within the watermark. It runs on ingestion
    time: origin times reach back centuries and would all be late."""
    events = normalise_snapshots(read_snapshots(spark, bronze, streaming=True))
    return events.withWatermark("ingested_at_utc", watermark).dropDuplicatesWithinWatermark(["event_id"])


def start(spark: SparkSession, bronze: str, staging: str, checkpoint: str, watermark: str = "30 days") -> StreamingQuery:
    return (
        new_events(spark, bronze, watermark)
        .writeStream.format("parquet")
        .option("path", staging)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
