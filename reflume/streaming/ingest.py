"""Resumable ingestion: files that were read once aren't read again, and progress and rows are committed together."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType


def ingest(spark: SparkSession, schema: StructType, pattern: str, out: str, progress: str, files_at_once: int = 10, seconds: int | None = None) -> None:
    """Appends the rows of new files to a Parquet table and ends when none is left, or after so many seconds; the next call goes on."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(pattern)
    running = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
    try:
        running.awaitTermination(seconds) if seconds else running.awaitTermination()
    finally:
        running.stop()
