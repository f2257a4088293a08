"""Lookups of keys in a service, remembered in a table, under one rate for all tasks.

What has been answered is kept as rows of key, answer (JSON, null for a key that the service doesn't know) and the number of the run; only keys that no
row has are asked for, each once however many rows need it. A run's tasks share out the service's rate: with n of them at
most, each waits n times the service's interval between calls, so all together stay within it whichever of them are
at work. A spent budget, of calls or of money, ends the run's lookups: answers so far are kept and the next run asks for the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pages import QuotaSpent

MEMO = "key string, answer string, run long"
#: Answers that a task holds before it passes them on.
AT_ONCE = 1000


class Session(Protocol):
    """What a task asks; it waits at least its interval between calls. QuotaSpent where there is no budget left."""

    def answer(self, key: str) -> str | None: ...


def memo(spark: SparkSession, folder: str) -> DataFrame:
    """The answers so far, one of each key."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    rows = spark.read.schema(MEMO).parquet(folder) if there else spark.createDataFrame([], MEMO)
    first = rows.groupBy("key").agg(F.min(F.struct("run", "answer")).alias("m"))  # a task that was run twice may have asked twice
    return first.select("key", "m.answer", "m.run")


def remember(keys: DataFrame, key: str, session: Callable[[float], Session], folder: str, interval: float, tasks: int = 4) -> int:
    """Asks for the keys that aren't remembered, with at most ``tasks`` sessions, each made with its share of the rate; how many are still unanswered.

    Null keys are never asked for.
    """
    spark = keys.sparkSession
    known = memo(spark, folder)
    run = (known.agg(F.max("run").alias("run")).first()["run"] or 0) + 1
    wanted = keys.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, rows = None, []
        for batch in batches:
            for k in batch["key"]:
                own = session(interval * tasks) if own is None else own
                try:
                    rows.append((k, own.answer(k), run))
                except QuotaSpent:
                    yield pd.DataFrame(rows, columns=["key", "answer", "run"])
                    return
                if len(rows) >= AT_ONCE:
                    yield pd.DataFrame(rows, columns=["key", "answer", "run"])
                    rows = []
        yield pd.DataFrame(rows, columns=["key", "answer", "run"])

    unseen = wanted.join(known, "key", "left_anti")
    unseen.repartition(tasks, "key").mapInPandas(ask, MEMO).write.mode("append").parquet(folder)
    return wanted.join(memo(spark, folder), "key", "left_anti").count()


def looked_up(rows: DataFrame, key: str, folder: str) -> DataFrame:
    """rows with asked, whether the key has been answered, and answer; both as remembered, nothing is asked for."""
    known = memo(rows.sparkSession, folder).select(F.col("key").alias("_key"), F.col("answer"), F.lit(True).alias("asked"))
    return rows.join(known, F.col(key).cast("string") == F.col("_key"), "left").drop("_key").withColumn("asked", F.coalesce("asked", F.lit(False)))
