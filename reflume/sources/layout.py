"""How large tables lie on disk, so that later reads and joins move less: buckets by a join's key, stored structs, Bloom filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path


def bucketed(rows: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Writes rows to the shared folder in buckets of the key, sorted by it, and reads them as a table.

    Tables with as many buckets of their keys are joined on them without a shuffle of either. A key that is very common fills its bucket: give joins on
    such keys a table without buckets.
    """
    spark = rows.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", shared_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def with_bloom_filters(rows: DataFrame, columns: list[str], name: str, distinct: int = 1_000_000) -> DataFrame:
    """Writes rows to the shared folder with Parquet Bloom filters on the columns, by which reads for single values skip row groups, and reads them back."""
    spark = rows.sparkSession
    path, writer = shared_path(spark, name), rows.write
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(distinct))
    writer.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def exchanges(frame: DataFrame) -> int:
    """Shuffles in a frame's plan, before it is run."""
    spark: SparkSession = frame.sparkSession
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = frame.select(*frame.columns)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    return plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition")
