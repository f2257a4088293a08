"""Totals over files that come one after another and survive restarts: partial sums of each batch, kept under the batch's number.

A batch is some new files. Its partial sums replace what an earlier try of the same batch has left, and the stream's own log says
which batches are done, with which files, so a run that ends between files, or in the middle of a batch, is gone on with by the
next: the same files come again under the same number, and none is counted twice or left out. Totals are the sums over the
batches that are done. Old batches can be merged into one base, which takes their place as soon as it is whole.

One run at a time adds to a folder; reading needs no lock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def written(rows: DataFrame, path: str) -> None:
    """Puts rows in place of whatever an earlier try has left there."""
    rows.write.mode("overwrite").parquet(path)


@dataclass(frozen=True)
class Totals:
    """Totals in a shared folder: ``schema`` is that of the partial sums, ``keys`` those of its columns that aren't summed."""

    spark: SparkSession
    folder: str
    schema: str
    keys: tuple[str, ...]

    def add(self, rows: StructType, pattern: str, partial: Callable[[DataFrame], DataFrame], files_at_once: int = 10, seconds: float | None = None) -> bool:
        """Adds the files that match and haven't been read; False where the time ran out first: finished batches stay, the rest is for the next call."""
        files = self.spark.readStream.schema(rows).option("maxFilesPerTrigger", files_at_once).parquet(pattern)

        def put(batch: DataFrame, number: int) -> None:
            written(partial(batch), f"{self.folder}/batch-{number}")

        running = files.writeStream.foreachBatch(put).option("checkpointLocation", f"{self.folder}/progress").trigger(availableNow=True).start()
        try:
            return running.awaitTermination(seconds) if seconds is not None else running.awaitTermination() or True
        finally:
            running.stop()

    def done(self) -> list[int]:
        """Numbers of the batches that the stream's log has as done."""
        return sorted(int(n) for n in self._names("progress/commits") if n.isdigit())

    def read(self) -> DataFrame:
        """The totals of what is done."""
        base = self._base()
        paths = [f"{self.folder}/batch-{n}" for n in self.done() if n > base]
        if base >= 0:
            paths.append(f"{self.folder}/base-{base}")
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        sums = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(*(F.sum(c).cast(dict(rows.dtypes)[c]).alias(c) for c in sums))

    def compact(self) -> None:
        """Merges the batches that are done into one base, then removes them and older bases."""
        done = self.done()
        if not done or done[-1] <= self._base():
            return
        written(self.read(), f"{self.folder}/base-{done[-1]}")
        for name in self._names(""):
            kind, _, number = name.partition("-")
            if kind == "batch" and int(number) <= done[-1] or kind == "base" and int(number) < done[-1]:
                self._files().delete(self._path(name), True)

    def _base(self) -> int:
        """The last batch of the newest whole base, -1 without one."""
        bases = [int(n[5:]) for n in self._names("") if n.startswith("base-") and "_SUCCESS" in self._names(n)]
        return max(bases, default=-1)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def _files(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return [x.getPath().getName() for x in self._files().listStatus(path)] if self._files().exists(path) else []
