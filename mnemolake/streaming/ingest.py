"""Incremental ingest with Structured Streaming, and windows over event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_files(spark: SparkSession, path: str, out: str, checkpoint: str, schema: str = "conv_id long, turn long, role string, text string"):
    """Takes in JSON files that are new since the last run and appends their rows to out as Parquet; returns when done."""
    source = spark.readStream.schema(schema).json(path)
    query = source.withColumn("scope", F.concat(F.lit("memory:"), F.col("conv_id").cast("string"))).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def event_windows(events: DataFrame, ts: str = "ts", size: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """Tumbling windows by event type; on a stream, rows later than the watermark are dropped."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if late and e.isStreaming:
        e = e.withWatermark(ts, late)
    return e.groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, ts: str = "ts", gap: str = "30 minutes") -> DataFrame:
    e = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return e.groupBy("user_id", F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
