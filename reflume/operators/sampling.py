"""Bounded samples that don't depend on partitioning: order is by a keyed hash, ties by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars


def hash_order(key: str, seed: int | str) -> Column:
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def reservoir(rows: DataFrame, groups: list[str], key: str, cap: int, seed: int | str = 0) -> DataFrame:
    """At most ``cap`` rows of each group, uniformly by hash; Spark limits groups before the shuffle."""
    order = Window.partitionBy(*groups).orderBy(hash_order(key, seed), key)
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")


def seen(rows: DataFrame, groups: list[str]) -> DataFrame:
    return rows.groupBy(*groups).agg(F.count("*").alias("seen"))


def bounded_sample(rows: DataFrame, key: str, size: int, seed: int | str = 0) -> DataFrame:
    """``size`` rows of all, as a top-k by hash."""
    return rows.orderBy(hash_order(key, seed), key).limit(size)


def cluster_sample(rows: DataFrame, key: str, share: float) -> DataFrame:
    """Rows whose key hashes below the share: whole clusters of equal keys."""
    return rows.where(scalars.stable_fraction(F.col(key).cast("string")) < share)


def shard(rows: DataFrame, key: str, k: int, n: int) -> DataFrame:
    """Every n-th row from k in the order of the key (a listing of files, so small)."""
    order = Window.orderBy(key)
    return rows.withColumn("i", F.row_number().over(order) - 1).where(F.col("i") % n == k).drop("i")


def complete_set(files: DataFrame) -> DataFrame:
    """Files ``<name>_<k>of<n>.csv`` of the n with most files; ties go to the larger n."""
    tagged = files.withColumn("n", F.regexp_extract("file", r"_(\d+)of(\d+)\.csv$", 2).cast("int")).where("n is not null")
    best = tagged.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).limit(1).select("n")
    return tagged.join(best, "n", "left_semi").select("file", "n")
