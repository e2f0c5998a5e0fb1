"""Structured Streaming over arriving snapshots and blobs (an extension of the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def snapshot_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Snapshots as they appear as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_blob_stream(blobs: DataFrame, delay: str = "1 hour", time_col: str = "time") -> DataFrame:
    """Each (blob_type, blob_id) once within the watermark."""
    return blobs.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["blob_type", "blob_id"])


def snapshot_counts(snapshots: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Snapshots by host and time window; late ones count until the watermark passes."""
    return snapshots.withWatermark("time", delay).groupBy(F.window("time", width), "hostname").agg(F.count("*").alias("snapshots"), F.max("time").alias("last_time"))
