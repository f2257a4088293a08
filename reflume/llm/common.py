"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable
from typing import TypeVar

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: Bytes of a batch that goes to Python, beyond its first row.
BATCH_BYTES = 4 << 20
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or in a local session the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return f"{base.rstrip('/')}/reflume-{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's interpreter ends."""
    if not _MADE:
        atexit.register(_sweep)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # the session has ended already
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Removes what ``materialize`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    folders = {path.rsplit("/", 1)[0] for path in df.inputFiles()}
    for folder in folders:
        if "/reflume-" in folder:
            remove(spark, folder)


def bucketed(df: DataFrame, key: str, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """Writes ``df`` to the shared folder by buckets of the key, so that joins on it shuffle the other side only; and what removes it."""
    spark = df.sparkSession
    path, table = stage_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), key).sortBy(key).option("path", path).saveAsTable(table)

    def forget() -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        remove(spark, path)

    return spark.table(table), forget


def bounded_batches(spark: SparkSession) -> None:
    """Lets batches of rows that go to Python end at BATCH_BYTES, unless the session says otherwise: texts may be long."""
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """What was made for the key, kept in this process from task to task until another key comes: one table at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(col):
    """Lower-cases A-Z and leaves every other character alone."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(col, upper, upper.lower())


def random_words(seed: int, size: int, dtype=np.uint64) -> np.ndarray:
    """A fixed table of random odd words, the same in every process."""
    bits = np.iinfo(dtype).bits
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << (bits - 1), size=size, dtype=dtype) * dtype(2) + dtype(1)


def powers(base: int, size: int) -> np.ndarray:
    """base ** 0 .. base ** (size - 1), modulo 2 ** 64."""
    with np.errstate(over="ignore"):
        out = np.full(size, np.uint64(base), np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer for 64-bit words: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def order_id(name: str = "doc_id"):
    """The id as a long, nulls as the smallest one."""
    return F.coalesce(F.col(name).cast("long"), F.lit(-(1 << 63)))


def id_cuts(rows: DataFrame, name: str, ranges: int) -> list[int]:
    """At most ``ranges`` - 1 ids that split the rows into ranges of like size; only they reach the driver."""
    shares = [i / ranges for i in range(1, ranges)]
    return sorted(set(rows.agg(F.percentile_approx(name, shares, 100 * ranges).alias("c")).first()["c"] or [])) if shares else []


def range_number(name: str, cuts: list[int]):
    """How many of the sorted cuts are at most the column, as nested halves."""

    def half(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        cut = f"{cuts[mid]}L" if cuts[mid] > -(1 << 63) else f"({cuts[mid] + 1}L - 1L)"
        return f"if({name} < {cut}, {half(lo, mid)}, {half(mid + 1, hi)})"

    return F.expr(half(0, len(cuts))).cast("int")


#: Words of 64 bits in a screen; its rows can't be more.
SCREEN_WORDS = 1 << 17


def screened(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """Adds _maybe to rows: false only where ``wanted``, one column of longs, doesn't hold the row's id.

    The ids' bits are set in a table of at most SCREEN_WORDS rows, which is broadcast whatever
    the size of wanted; the more it holds, the more rows are let through. An exact join
    follows, over few rows where wanted is short, without a shuffle of the others.
    """
    spread = F.xxhash64(F.coalesce(F.col(name).cast("long"), F.lit(-(1 << 63))))
    place = F.pmod(spread, F.lit(SCREEN_WORDS * 64))
    bits = wanted.toDF("_id").select(F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("long"), F.lit(-(1 << 63)))), F.lit(SCREEN_WORDS * 64)).alias("_place"))
    bits = bits.groupBy(F.expr("shiftright(_place, 6)").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 as int))")).alias("_bits"))
    packed = rows.select(F.struct(*rows.columns).alias("_row"), place.alias("_place")).withColumn("_word", F.expr("shiftright(_place, 6)"))
    maybe = F.coalesce(F.expr("shiftright(_bits, cast(_place & 63 as int)) & 1") == 1, F.lit(False))
    return packed.join(F.broadcast(bits), "_word", "left").select(*(F.col(f"_row.{c}") for c in rows.columns), maybe.alias("_maybe"))
