"""Streams that go on where the last run stopped."""

import datetime as dt
import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from pathlib import Path

import pytest

from marketloom.sources import connector
from marketloom.streaming import states, stores

T = dt.datetime


def drop(spark, folder, name, rows, schema):
    """One more file in a folder that a stream reads."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def read_of(store, spark):
    """Rows that each run of a store's stream has read, by the checkpoint's source log."""
    return sum(1 for p in Path(store).glob("state/*/sources/0/*") if not p.name.startswith("."))


def test_documents_over_three_runs(spark, tmp_path):
    schema, folder, store = "k string, prelim boolean, n long, text string", tmp_path / "in", str(tmp_path / "store")

    def run():
        rows = spark.readStream.schema(schema).parquet(str(folder))
        return sorted((r.k, r.prelim, r.text) for r in states.documents(rows, "k", "prelim", "n", store).collect())

    drop(spark, folder, "a", [("a", True, 1, "a1"), ("a", True, 2, "a2"), ("b", False, 2, "b2"), ("b", True, 3, "b3"), (None, True, 1, "x"), ("c", None, 1, "c1")], schema)
    assert run() == [("a", True, "a2"), ("b", False, "b2"), ("c", False, "c1")]
    drop(spark, folder, "b", [("a", False, 0, "a0"), ("b", True, 9, "b9"), ("d", True, 1, "d1")], schema)
    assert run() == [("a", False, "a0"), ("b", False, "b2"), ("c", False, "c1"), ("d", True, "d1")]
    drop(spark, folder, "c", [("a", True, 10, "late"), ("b", False, 1, "b1"), ("d", True, 0, "d0")], schema)
    assert run() == [("a", False, "a0"), ("b", False, "b1"), ("c", False, "c1"), ("d", True, "d0")]
    assert run() == run()


def test_ledger_reads_new_files_only(spark, tmp_path):
    schema, folder, store = "id string, n long", tmp_path / "in", str(tmp_path / "store")
    progress = []

    def run():
        rows = spark.readStream.schema(schema).parquet(str(folder))
        out = sorted(r.id for r in stores.ledger(rows, "id", store).collect())
        progress.append(read_of(store, spark))
        return out

    drop(spark, folder, "a", [("a", 1), ("a", 2), (None, 1)], schema)
    assert run() == ["a"]
    drop(spark, folder, "b", [("a", 3), ("b", 1)], schema)
    assert run() == ["a", "b"]
    drop(spark, folder, "c", [("c", 3), ("b", 1)], schema)
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]
    assert progress == [1, 2, 3, 3]  # a batch a run, of that run's files; none for the last


def test_upserts_keep_their_buckets(spark, tmp_path):
    schema, folder, store = "id string, n long, x long", tmp_path / "in", str(tmp_path / "store")
    drop(spark, folder, "a", [(f"k{i}", 1, i) for i in range(50)], schema)
    run = lambda buckets: sorted((r.id, r.n, r.x) for r in stores.upserted(spark.readStream.schema(schema).parquet(str(folder)), ["id"], ["n"], store, buckets).collect())
    assert run(4) == sorted((f"k{i}", 1, i) for i in range(50))
    drop(spark, folder, "b", [("k3", 2, 100), ("k4", 0, 100), ("new", 1, 1)], schema)
    got = run(16)
    assert len(got) == 51 and ("k3", 2, 100) in got and ("k4", 1, 4) in got


def test_late_values_change_provisional_bars_only(spark, tmp_path):
    schema, folder, store = "sym string, ts timestamp, value double, id long", tmp_path / "in", str(tmp_path / "store")
    at = lambda h, m=0: T(2024, 1, 1, h, m)

    def run():
        got = states.forming_bars(spark.readStream.schema(schema).parquet(str(folder)), store, "1 hour")
        return {(r.sym, r.ts.hour): (r.o, r.h, r.l, r.c, r.v, r.provisional) for r in got.collect()}

    drop(spark, folder, "a", [("a", at(9, 5), 1.0, 1), ("a", at(9, 50), 3.0, 2), ("a", at(12, 10), 5.0, 3), (None, at(9), 1.0, 4), ("a", None, 1.0, 5)], schema)
    assert run() == {("a", 9): (1.0, 3.0, 1.0, 3.0, 2.0, False), ("a", 12): (5.0, 5.0, 5.0, 5.0, 1.0, True)}
    drop(spark, folder, "b", [("a", at(9, 1), 99.0, 6), ("a", at(12, 5), 2.0, 7), ("a", at(11, 30), 4.0, 8)], schema)  # the first is too late, the others aren't
    assert run() == {("a", 9): (1.0, 3.0, 1.0, 3.0, 2.0, False), ("a", 11): (4.0, 4.0, 4.0, 4.0, 1.0, True), ("a", 12): (2.0, 5.0, 2.0, 5.0, 2.0, True)}
    drop(spark, folder, "c", [("a", at(15), 7.0, 9)], schema)
    assert {k: x[-1] for k, x in run().items()} == {("a", 9): False, ("a", 11): False, ("a", 12): False, ("a", 15): True}


@pytest.fixture(scope="module")
def host():
    """A local host under two names, which writes down what it is asked for."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked.append((self.headers["Host"].split(":")[0], self.path, time.monotonic()))
            self.send_response(404 if "none" in self.path else 200)
            self.end_headers()
            self.wfile.write(f"page {self.path}".encode())

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_address[1], asked
    server.shutdown()


@pytest.fixture(scope="module")
def fetch():
    def get(url):
        import urllib.request

        with urllib.request.urlopen(url, timeout=5) as r:  # an HTTPError is an OSError
            return r.read().decode()

    return get


def test_crawl_goes_on_and_paces_by_host(spark, tmp_path, host, fetch):
    port, asked = host
    urls, store = str(tmp_path / "urls"), str(tmp_path / "pages")
    named = [f"http://{h}:{port}/{i}" for h in ("127.0.0.1", "localhost") for i in range(6)]
    table = lambda x: spark.createDataFrame([(u,) for u in x], "url string")
    assert connector.add_urls(table([*named, named[0], None]), urls) == 12
    first = connector.crawl(spark, urls, store, fetch, 0.2, batch=8, batches=1)
    assert first.count() == 8 and len(asked) == 8
    assert connector.add_urls(table([named[3], f"http://localhost:{port}/none", f"http://localhost:{port}/more"]), urls) == 14
    got = connector.crawl(spark, urls, store, fetch, 0.2, batch=8).collect()  # as after a restart: only table and store say what is done
    assert Counter(x[:2] for x in asked).most_common(1)[0][1] == 1 and len(asked) == 14
    assert {r.url for r in got} == {r.url for r in connector.url_table(spark, urls).collect()} and sorted(r.n for r in got) == list(range(14))
    assert [(r.payload, bool(r.error)) for r in got if "none" in r.url] == [(None, True)] and all(r.payload for r in got if "none" not in r.url)
    by_host = {}
    for h, _, t in asked:
        by_host.setdefault(h, []).append(t)
    assert all(b - a > 0.15 for x in by_host.values() for a, b in zip(sorted(x), sorted(x)[1:]))
    spans = [(min(x), max(x)) for x in ([t for h, _, t in asked[:8] if h == name] for name in by_host) if x]
    assert len(spans) == 2 and max(s[0] for s in spans) < min(s[1] for s in spans)  # side by side
    rows = connector.with_payloads(table([named[0], "never"]), connector.results(spark, store))
    assert {r.url: r.payload for r in rows.collect()} == {named[0]: "page /0", "never": None}
    assert connector.crawl(spark, urls, store, fetch, 0).count() == 14 and len(asked) == 14


def test_empty_crawl(spark, tmp_path, fetch):
    assert connector.crawl(spark, str(tmp_path / "urls"), str(tmp_path / "pages"), fetch).count() == 0
    assert connector.add_urls(spark.createDataFrame([], "url string"), str(tmp_path / "urls")) == 0
