"""Incremental ingest with Structured Streaming: resumable chunks, watermarked windows, first-seen records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tail(spark: SparkSession, path: str, like: DataFrame, files_per_batch: int = 64) -> DataFrame:
    """Files of a folder as a stream, with the schema of a batch table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(stream: DataFrame, at: str, key: str, size: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Rows per key and event-time window; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def first_seen(stream: DataFrame, at: str, keys: list[str], late: str = "7 days") -> DataFrame:
    """The first row of each key within the watermark; state is dropped once it has passed."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process all there is and stop; a second call goes on from the checkpoint, exactly once."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
