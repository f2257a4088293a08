"""Paged services as a Spark data source: a partition for each query in a batch, cursors as offsets in a stream.

``spark.read.format("paged")`` reads all pages of each query, every query in a task of its own.
``spark.readStream.format("paged")`` reads some pages of each query in a batch; how far each has come is the stream's offset, so a
stream that is started again goes on with the next page, and only a batch that wasn't committed is asked for again. A spent quota
ends a batch with what has been read; the next one goes on.

Services are a REST service that gives cursors (``service=http``) or a Parquet table, whose rows that match a query come in pages by a
key (``service=table``). One pass over a table finds as many pages beyond the cursor as AHEAD_BYTES hold.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from .pages import FIRST, QuotaSpent, Service

if TYPE_CHECKING:
    import numpy as np
    import pyarrow as pa

#: Bytes of a query's rows that a table service keeps between pages, and queries whose rows are kept.
AHEAD_BYTES, QUERIES_AHEAD = 16 << 20, 8
#: Seconds and records of a stream's batch beyond which batches don't grow.
SLOW, MANY = 10.0, 100_000
SCHEMA = "query string, page long, cursor string, record string"
Page = tuple[list[str], str | None]


class RestPages:
    """Pages of a REST service: options base, path, perPage, interval, tries and pause."""

    def __init__(self, options: dict[str, str]):
        self.service = Service(options["base"], float(options.get("interval", "0.15")), int(options.get("tries", "12")), float(options.get("pause", "2.0")))
        self.path, self.size = options.get("path", "/works"), int(options.get("perpage", "200"))

    def page(self, query: str, cursor: str) -> Page:
        """Records and the cursor that follows, None after the last page; a refused query has no records."""
        found = self.service.get(self.path, filter=query, cursor=cursor, **{"per-page": self.size}) or {}
        return [json.dumps(r) for r in found.get("results", [])], found.get("meta", {}).get("next_cursor")


class TablePages:
    """Pages of a Parquet table, in the order of an integer key: options path, key, columns (comma-joined) and perPage. A query is ``column=value``."""

    def __init__(self, options: dict[str, str]):
        self.path, self.key, self.size = re.sub("^file:/(?!/)", "file:///", options["path"]), options["key"], int(options.get("perpage", "200"))
        self.columns = options.get("columns", self.key).split(",")
        self.ahead: dict[str, Ahead] = {}

    def page(self, query: str, cursor: str) -> Page:
        low = None if cursor == FIRST else int(cursor)
        held = self.ahead.pop(query, None)
        if held is None or not held.has(low, self.size):
            held = self.read(query, low)
        self.ahead[query] = held
        if len(self.ahead) > QUERIES_AHEAD:
            self.ahead.pop(next(iter(self.ahead)))
        rows = held.rows.slice(held.place(low), self.size + 1).to_pylist()
        after = rows[self.size][self.key] if len(rows) > self.size else None
        rows = rows[: self.size]
        if after is not None and rows[-1][self.key] == after:
            raise ValueError(f"{self.key} isn't unique: pages by it would lose rows")
        return [json.dumps({c: r[c] for c in self.columns}) for r in rows], None if after is None else str(rows[-1][self.key])

    def read(self, query: str, low: int | None) -> Ahead:
        """The query's rows of the least keys beyond the cursor, in one pass: as many as AHEAD_BYTES hold, and more than a page."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        column, _, value = query.partition("=")
        wanted = (pc.field(column) == value) & ~pc.field(self.key).is_null()
        if low is not None:
            wanted &= pc.field(self.key) > low
        table, names = ds.dataset(self.path, format="parquet"), [*dict.fromkeys([self.key, *self.columns])]
        schema = pa.schema([table.schema.field(c) for c in names])
        held, size, last = [], 0, None  # no row beyond the key ``last`` is held any more

        def in_order(batches: list[pa.RecordBatch]) -> pa.Table:
            rows = pa.Table.from_batches(batches, schema)
            return rows.take(pc.sort_indices(rows, [(self.key, "ascending")]))

        for batch in table.to_batches(columns=names, filter=wanted):
            if last is not None:
                batch = batch.filter(pc.less_equal(batch.column(self.key), last))
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size > 2 * AHEAD_BYTES:
                rows = in_order(held)
                n = max(self.size + 1, rows.num_rows * AHEAD_BYTES // rows.nbytes)
                if n < rows.num_rows:
                    last = rows.column(self.key)[n - 1]
                    rows = rows.filter(pc.less_equal(rows.column(self.key), last))
                held, size = rows.to_batches(), rows.nbytes
        rows = in_order(held)
        return Ahead(rows, rows.column(self.key).to_numpy(), low, last is None)


@dataclass
class Ahead:
    """Rows beyond a cursor, none for the table's start, in the order of their keys; whether they are all."""

    rows: pa.Table
    keys: np.ndarray
    low: int | None
    whole: bool

    def place(self, low: int | None) -> int:
        return 0 if low is None else int(self.keys.searchsorted(low, "right"))

    def has(self, low: int | None, size: int) -> bool:
        """Whether the page beyond a cursor, and whether another follows, can be told from these rows."""
        if self.low is not None and (low is None or low < self.low):
            return False
        return self.whole or self.place(low) + size < len(self.keys)


def serve(rows: DataFrame, path: str, column: str, key: str) -> None:
    """Writes rows for a table service: in the order of what queries ask for and of the key, so that files' statistics leave out what isn't asked for."""
    rows.repartitionByRange(column, key).sortWithinPartitions(column, key).write.parquet(path)


def service_of(options: dict[str, str]):
    kinds = {"http": RestPages, "table": TablePages}
    kind = options.get("service", "http")
    if kind not in kinds:
        raise ValueError(f"service is one of {', '.join(kinds)}")
    return kinds[kind](options)


def queries_of(options: dict[str, str]) -> list[str]:
    """The option queries, a JSON list, each query once."""
    return list(dict.fromkeys(json.loads(options["queries"])))


@dataclass
class OfQuery(InputPartition):
    query: str


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [OfQuery(q) for q in queries_of(self.options)]

    def read(self, partition: OfQuery) -> Iterator[tuple]:
        service, cursor = service_of(self.options), FIRST
        for page in count():
            records, after = service.page(partition.query, cursor)
            for r in records:
                yield partition.query, page, cursor, r
            if not after:
                return
            cursor = after


class PagedStream(SimpleDataSourceStreamReader):
    """Offsets: for each query its next page's number and cursor, no cursor when it is done.

    The first batch after a start has pagesAtOnce pages of each query. Every batch costs a commit, so the next one has twice as many,
    until reading it takes SLOW seconds or gives MANY records.
    """

    def __init__(self, options: dict[str, str]):
        self.options, self.queries, self.at_once = options, queries_of(options), int(options.get("pagesatonce", "5"))
        self._service = None

    def initialOffset(self) -> dict:
        return {}

    def service(self):
        if self._service is None:
            self._service = service_of(self.options)
        return self._service

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows: list[tuple] = []
        end, began = dict(start), time.monotonic()
        for query in self.queries:
            page, cursor = end.get(query, [0, FIRST])
            for _ in range(self.at_once):
                if cursor is None:
                    break
                try:
                    records, after = self.service().page(query, cursor)
                except QuotaSpent:
                    return iter(rows), end
                rows += [(query, page, cursor, r) for r in records]
                page, cursor = page + 1, after
                end[query] = [page, cursor]
        if end != start and time.monotonic() - began < SLOW / 2 and len(rows) <= MANY // 2:
            self.at_once *= 2
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        for query, (last, _) in end.items():
            page, cursor = start.get(query, [0, FIRST])
            while page < last and cursor is not None:
                records, after = self.service().page(query, cursor)
                yield from ((query, page, cursor, r) for r in records)
                page, cursor = page + 1, after


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self._options())

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return PagedStream(self._options())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def follow(spark: SparkSession, out: str, progress: str, **options: str) -> None:
    """Appends the records of all pages that can be read now to a Parquet table, and ends; the next call goes on after them."""
    register(spark)
    rows = spark.readStream.format("paged").options(**options).load()
    running = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(processingTime="0 seconds").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
