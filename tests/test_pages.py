"""The paged harvest against a service on this machine, which throttles, fails and runs out of quota."""

import json
import threading
import urllib.parse
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from reflume.sources import paged, pages

TOTAL, PER_PAGE = {"a": 25, "b": 7, "none": 0, "refused": 9}, 5


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        calls, quota = Counter(), 10**9

        def answer(self, code, body=None, **headers):
            self.send_response(code)
            for k, v in headers.items():
                self.send_header(k.replace("_", "-"), str(v))
            self.end_headers()
            self.wfile.write(json.dumps(body or {}).encode())

        def do_GET(self):
            asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            query, cursor = asked["filter"], asked["cursor"]
            Handler.calls[query, cursor] += 1
            if query == "refused":
                return self.answer(400)
            if Handler.calls[query, cursor] == 1 and cursor == "c10":
                return self.answer(503)
            if Handler.calls[query, cursor] == 1 and cursor == "c5":
                return self.answer(429, Retry_After=0)
            if Handler.quota <= 0:
                return self.answer(429, x_ratelimit_remaining=0)
            Handler.quota -= 1
            at = 0 if cursor == "*" else int(cursor[1:])
            rows = [{"id": f"{query}{i}", "n": i} for i in range(at, min(TOTAL[query], at + int(asked["per-page"])))]
            more = f"c{at + PER_PAGE}" if at + PER_PAGE < TOTAL[query] else None
            self.answer(200, {"results": rows, "meta": {"count": TOTAL[query], "next_cursor": more}})

        def log_message(self, *args):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made.server_address[1], Handler
    made.shutdown()


def test_harvest_resumes_after_a_spent_quota(spark, server, tmp_path):
    port, handler = server
    base, folder = f"http://127.0.0.1:{port}", str(tmp_path / "pages")
    service = lambda: pages.Service(base, interval=0, pause=0.01, tries=4)
    handler.quota = 3
    assert not pages.harvest(spark, service, list(TOTAL), folder, per_page=PER_PAGE, pages_at_once=2, at_once=2)
    handler.quota = 10**9
    assert not pages.harvest(spark, service, list(TOTAL), folder, per_page=PER_PAGE, seconds=-1)
    assert pages.harvest(spark, service, list(TOTAL), folder, per_page=PER_PAGE, pages_at_once=2, at_once=2)
    found = sorted((r.query, r.id) for r in pages.records(spark, folder, "id string, n int").collect())
    assert found == sorted((q, f"{q}{i}") for q in ("a", "b") for i in range(TOTAL[q]))
    asked = sum(handler.calls.values())
    assert pages.harvest(spark, service, list(TOTAL), folder, per_page=PER_PAGE) and sum(handler.calls.values()) == asked


def test_a_service_that_stays_down_is_an_error(server):
    port, handler = server
    handler.calls.clear()
    with pytest.raises(RuntimeError, match="gave up"):
        pages.Service(f"http://127.0.0.1:{port + 1}", interval=0, pause=0.01, tries=2).get("/works", filter="a", cursor="*")


def options(server, queries):
    port, _ = server
    return {"service": "http", "base": f"http://127.0.0.1:{port}", "interval": "0", "pause": "0.01", "tries": "4", "perPage": str(PER_PAGE), "queries": json.dumps(queries)}


def names(rows):
    return sorted((r.query, json.loads(r.record)["id"], r.page) for r in rows)


WANTED = sorted((q, f"{q}{i}", i // PER_PAGE) for q in ("a", "b") for i in range(TOTAL[q]))


def test_batch_source_reads_each_query_in_a_task(spark, server):
    server[1].calls.clear()
    server[1].quota = 10**9
    paged.register(spark)
    rows = spark.read.format("paged").options(**options(server, [*TOTAL, "a"])).load()
    assert rows.rdd.getNumPartitions() == len(TOTAL)
    assert names(rows.collect()) == WANTED


def test_stream_goes_on_after_its_cursors(spark, server, tmp_path):
    """A spent quota ends the first run; the second asks for no page that the first has had."""
    _, handler = server
    handler.calls.clear()
    handler.quota = 3
    where = (str(tmp_path / "rows"), str(tmp_path / "progress"))
    paged.follow(spark, *where, pagesAtOnce="2", **options(server, list(TOTAL)))
    first = spark.read.schema(paged.SCHEMA).parquet(where[0]).count()
    assert 0 < first < len(WANTED)
    had = {k for k, n in handler.calls.items() if k[0] in "ab" and n and k[1] in ("*", "c5")}
    handler.quota = 10**9
    before = dict(handler.calls)
    paged.follow(spark, *where, pagesAtOnce="2", **options(server, list(TOTAL)))
    assert names(spark.read.schema(paged.SCHEMA).parquet(where[0]).collect()) == WANTED
    assert handler.calls["a", "*"] == before["a", "*"] == 1 and had
    asked = sum(handler.calls.values())
    paged.follow(spark, *where, pagesAtOnce="2", **options(server, list(TOTAL)))
    assert sum(handler.calls.values()) == asked


def test_replayed_offsets_give_the_same_rows(spark, tmp_path):
    spark.range(23).selectExpr("id * 3 as k", "if(id % 2 = 0, 'x', 'y') as g", "id as v").repartition(3).write.parquet(str(tmp_path / "t"))
    given = {"service": "table", "path": str(tmp_path / "t"), "key": "k", "columns": "v", "perpage": "4", "pagesatonce": "2", "queries": '["g=x", "g=y", "g=z"]'}
    one = paged.PagedStream(given)
    offset, seen = one.initialOffset(), []
    while True:
        rows, end = one.read(offset)
        rows = list(rows)
        if end == offset:
            break
        assert list(paged.PagedStream(given).readBetweenOffsets(offset, end)) == rows
        seen += rows
        offset = json.loads(json.dumps(end))
    assert sorted(json.loads(r[3])["v"] for r in seen) == list(range(23)) and max(r[1] for r in seen) == 2
    with pytest.raises(ValueError, match="isn't unique"):
        paged.TablePages({**given, "key": "v", "path": str(same(spark, tmp_path))}).page("g=x", "*")


def same(spark, tmp_path):
    spark.range(9).selectExpr("id div 5 as v", "'x' as g").coalesce(1).write.parquet(str(tmp_path / "same"))
    return tmp_path / "same"


def walked(service, query):
    """All rows, page by page, each page asked for a second time by a service that has read nothing yet."""
    cursor, seen = "*", []
    while cursor:
        rows, after = service.page(query, cursor)
        assert paged.TablePages(GIVEN | {"path": service.path}).page(query, cursor) == (rows, after)
        seen, cursor = seen + [rows], after
    return seen


GIVEN = {"key": "k", "columns": "v", "perpage": "4"}


@pytest.mark.parametrize("ahead", [1, 300, 1 << 20])
def test_pages_of_a_table_take_few_passes(spark, tmp_path, monkeypatch, ahead):
    """Whatever the order of the rows and however few of them may be held; a cursor that goes back is answered too."""
    import pyarrow.dataset as ds

    path = str(tmp_path / "t")
    spark.range(203).selectExpr("(id * 89) % 203 - 50 as k", "if(id % 2 = 0, 'x', 'y') as g", "(id * 89) % 203 as v").repartition(5).write.parquet(path)
    monkeypatch.setattr(paged, "AHEAD_BYTES", ahead, raising=False)
    kept = sorted(r.v for r in spark.read.parquet(path).where("g = 'x'").collect())
    service = paged.TablePages(GIVEN | {"path": path})
    pages = walked(service, "g=x")
    assert [json.loads(r)["v"] for rows in pages for r in rows] == kept and {len(rows) for rows in pages[:-1]} == {4}
    assert service.page("g=x", "*")[0] == pages[0] and service.page("g=none", "*") == ([], None)
    passes, real = [], ds.dataset
    monkeypatch.setattr(ds, "dataset", lambda *a, **k: passes.append(1) or real(*a, **k))
    service, cursor, asked = paged.TablePages(GIVEN | {"path": path}), "*", 0
    while cursor:
        cursor, asked = service.page("g=x", cursor)[1], asked + 1
    assert asked == 26 and len(passes) <= {1: 26, 300: 13, 1 << 20: 1}[ahead]


@pytest.mark.parametrize(("slow", "many", "least", "most"), [(60.0, 10**6, 5, 8), (0.0, 10**6, 51, 51), (60.0, 16, 13, 16)])
def test_batches_of_a_stream_grow(spark, tmp_path, monkeypatch, slow, many, least, most):
    """Until they are slow or large; the pages are the same, and those of each batch can be read again."""
    spark.range(203).selectExpr("id as k", "'x' as g").coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(paged, "SLOW", slow, raising=False)
    monkeypatch.setattr(paged, "MANY", many, raising=False)
    given = {"service": "table", "path": str(tmp_path / "t"), "key": "k", "perpage": "4", "pagesatonce": "1", "queries": '["g=x", "g=none"]'}
    one, offset, batches = paged.PagedStream(given), {}, []
    while True:
        rows, end = one.read(offset)
        rows = list(rows)
        if end == offset:
            break
        assert list(paged.PagedStream(given).readBetweenOffsets(offset, end)) == rows and len(rows) <= many
        offset = json.loads(json.dumps(end))
        batches.append(rows)
    assert [(json.loads(r[3])["k"], r[1]) for rows in batches for r in rows] == [(k, k // 4) for k in range(203)]
    assert least <= len(batches) <= most
