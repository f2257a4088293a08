"""Harvests from paged REST services: queries by cursor on the executors, with retries, a rate and a quota, that go on where they stopped.

The table of pages is the state: each row holds a query, its page's number, the cursor that follows
(null after the last page) and the page's records as JSON. A run asks for the next pages of all queries that aren't done, some
at a time, and appends them; a lost task asks again for its own pages only.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "query string, page long, next string, records array<string>, spent boolean"
FIRST = "*"


class QuotaSpent(RuntimeError):
    """The service gives no more for now; what has been read is kept and the next run goes on."""


class Service:
    """GET with a least interval between calls, and retries of what passes: throttling, time-outs, errors of the server."""

    def __init__(self, base: str, interval: float = 0.15, tries: int = 12, pause: float = 2.0, longest: float = 120.0):
        self.base, self.interval, self.tries, self.pause, self.longest, self.last = base, interval, tries, pause, longest, 0.0

    def get(self, path: str, **params: str | int) -> dict | None:
        """The answer's JSON; None for what the service refuses (4xx). A spent quota is raised."""
        url = f"{self.base}{path}?{urllib.parse.urlencode(params)}"
        for n in range(self.tries):
            time.sleep(max(0.0, self.interval - (time.monotonic() - self.last)))
            self.last = time.monotonic()
            try:
                with urllib.request.urlopen(url, timeout=60) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code == 402 or e.code == 429 and (_spent(e.headers.get("x-ratelimit-remaining")) or _spent(e.headers.get("x-ratelimit-remaining-usd"))):
                    raise QuotaSpent(url) from e
                if e.code < 500 and e.code not in (408, 429):
                    return None
                after = e.headers.get("Retry-After", "")
                wait = int(after) + 1 if after.isdigit() else self.pause * 2**n
            except (urllib.error.URLError, TimeoutError):
                wait = self.pause * 2**n
            time.sleep(min(wait, self.longest))
        raise RuntimeError(f"gave up after {self.tries} tries: {url}")


def _spent(left: str | None) -> bool:
    """Whether a header says that no calls, or no money, are left; an unreadable one doesn't."""
    try:
        return float(left or "") <= 0
    except ValueError:
        return False


def open_queries(spark: SparkSession, queries: list[str], folder: str) -> DataFrame:
    """query, page and cursor to ask for next, of the queries that aren't done."""
    asked = spark.createDataFrame([(q, 0, FIRST) for q in dict.fromkeys(queries)], "query string, page long, cursor string")
    read = _pages(spark, folder).where("not spent").groupBy("query").agg(F.max(F.struct("page", "next")).alias("last"))
    at = asked.join(read, "query", "left")
    return at.where("last is null or last.next is not null").select("query", F.coalesce(F.col("last.page") + 1, F.lit(0)).alias("page"), F.coalesce("last.next", "cursor").alias("cursor"))


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(PAGES).parquet(folder) if there else spark.createDataFrame([], PAGES)


def harvest(spark: SparkSession, service: Callable[[], Service], queries: list[str], folder: str, path: str = "/works", per_page: int = 200, pages_at_once: int = 10, at_once: int = 4, seconds: float | None = None) -> bool:
    """Reads the pages of all queries into a table; True when all are done, False where the quota or the time is spent.

    ``at_once`` bounds the connections, ``pages_at_once`` the pages of a query between two commits.
    """
    began = time.monotonic()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = service()
        for batch in batches:
            for query, page, cursor in batch.itertuples(index=False):
                rows = []
                for n in range(page, page + pages_at_once):
                    try:
                        answer = own.get(path, filter=query, cursor=cursor, **{"per-page": per_page})
                    except QuotaSpent:
                        rows.append((query, n, cursor, [], True))
                        break
                    found = answer or {}
                    cursor = found.get("meta", {}).get("next_cursor")
                    rows.append((query, n, cursor, [json.dumps(r) for r in found.get("results", [])], False))
                    if not cursor:
                        break
                yield pd.DataFrame(rows, columns=["query", "page", "next", "records", "spent"])

    while True:
        waiting = open_queries(spark, queries, folder)
        if waiting.isEmpty():
            return True
        if seconds is not None and time.monotonic() - began > seconds:
            return False
        before = _pages(spark, folder).where("spent").count()
        waiting.repartition(at_once, "query").mapInPandas(ask, PAGES).write.mode("append").parquet(folder)
        if _pages(spark, folder).where("spent").count() > before:
            return False


def records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """query and the fields of each record that was read; a page that was asked for twice counts once."""
    once = _pages(spark, folder).where("not spent").dropDuplicates(["query", "page"])
    return once.select("query", F.explode("records").alias("r")).select("query", F.from_json("r", schema).alias("r")).select("query", "r.*")
