"""Lookups against a service on this machine: each key once, one rate for all tasks, a budget that runs out."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from reflume.sources import lookups, pages


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        calls, quota, header = [], 10**9, "x-ratelimit-remaining-usd"

        def do_GET(self):
            key = self.path.split("?")[0].rsplit("/", 1)[-1]
            Handler.calls.append((time.monotonic(), key))
            if Handler.quota <= 0:
                self.send_response(429)
                self.send_header(Handler.header, "0.0000")
                self.end_headers()
                return
            Handler.quota -= 1
            self.send_response(404 if key.startswith("no") else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"key": key}).encode())

        def log_message(self, *args):
            pass

    made = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made.server_address[1], Handler
    made.shutdown()


def session_of(port):
    class Session:
        def __init__(self, interval):
            self.service = pages.Service(f"http://127.0.0.1:{port}", interval=interval, pause=0.01, tries=3)

        def answer(self, key):
            found = self.service.get(f"/works/{key}")
            return None if found is None else json.dumps(found)

    return Session


def table(spark, names):
    return spark.createDataFrame([(n, k) for n, k in enumerate(names)], "n int, doi string").repartition(8)


def test_each_key_is_asked_for_once(spark, server, tmp_path):
    port, handler = server
    handler.calls.clear()
    rows, folder = table(spark, [*(f"k{n % 20}" for n in range(300)), "no1", None]), str(tmp_path / "memo")
    assert lookups.remember(rows, "doi", session_of(port), folder, 0.0) == 0
    assert sorted(k for _, k in handler.calls) == sorted([*(f"k{n}" for n in range(20)), "no1"])
    assert lookups.remember(rows, "doi", session_of(port), folder, 0.0) == 0 and len(handler.calls) == 21
    assert lookups.remember(table(spark, ["k1", "new"]), "doi", session_of(port), folder, 0.0) == 0 and handler.calls[21:][0][1] == "new"
    found = {r.n: r for r in lookups.looked_up(rows, "doi", folder).collect()}
    assert len(found) == 302 and json.loads(found[7].answer) == {"key": "k7"}
    assert (found[300].asked, found[300].answer) == (True, None) and (found[301].asked, found[301].answer) == (False, None)


def test_all_tasks_share_one_rate(spark, server, tmp_path):
    """Twenty calls a second at most, with eight sessions, of which four run at a time."""
    port, handler = server
    handler.calls.clear()
    assert lookups.remember(table(spark, [f"k{n}" for n in range(60)]), "doi", session_of(port), str(tmp_path / "memo"), 0.05, tasks=8) == 0
    times = sorted(t for t, _ in handler.calls)
    assert len(times) == 60
    assert all(sum(a <= t < a + 1.0 for t in times) <= 20 + 8 for a in times)  # each session's first call waits for nothing


@pytest.mark.parametrize("header", ["x-ratelimit-remaining-usd", "x-ratelimit-remaining"])
def test_a_spent_budget_keeps_the_answers(spark, server, tmp_path, header):
    port, handler = server
    handler.calls.clear()
    handler.quota, handler.header = 5, header
    rows, folder = table(spark, [f"k{n}" for n in range(12)]), str(tmp_path / "memo")
    assert lookups.remember(rows, "doi", session_of(port), folder, 0.0, tasks=1) == 7
    handler.quota = 10**9
    assert lookups.remember(rows, "doi", session_of(port), folder, 0.0, tasks=2) == 0
    answered = [k for _, k in handler.calls]
    assert len(answered) == 13 and len(set(answered)) == 12  # only the call that the budget refused was made again
