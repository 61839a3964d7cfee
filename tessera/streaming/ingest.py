"""Incremental ingest: weekly counts of a comment stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import SCHEMAS


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as they land; the event time is a timestamp, as watermarks need."""
    return spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def weekly(events: DataFrame) -> DataFrame:
    """(week, event_type, n, users) by Monday weeks; late rows up to two days."""
    w = F.window("ts", "7 days", startTime="4 days")
    return events.withWatermark("ts", "2 days").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("week"), "event_type", "n")


def stream_weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All weeks of what has landed so far, through the stream."""
    name = f"weekly_{uuid.uuid4().hex}"
    query = weekly(stream(spark, sf_dir)).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
