"""The folder that driver and executors share, and tables that are written there once to be read several times."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_SHARED: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or, in a local session without it, below the warehouse; removed when the interpreter ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    if not _SHARED:
        atexit.register(_sweep)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SHARED.append((spark, path))
    return path


def staged(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows to the shared folder and reads them back, so that what made them runs once."""
    spark = rows.sparkSession
    path = shared_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _SHARED:
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended already
            return
