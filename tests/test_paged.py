"""Paged sources: a local server, and landed pages with gaps and failures."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.errors import PySparkException

from rangeledger.sources import paged

RECORD = "name string, n long"


def body(rows, total):
    return json.dumps({"data": [{"name": f"r{i}", "n": i, "more": [1]} for i in rows], "recordsTotal": total})


def landed(spark, pages):
    return spark.createDataFrame(pages, "start long, body string").repartition(3)


def numbers(df):
    return sorted(r["n"] for r in df.collect())


def test_where_reading_ends(spark):
    whole = [(s, body(range(s, min(s + 3, 8)), 8)) for s in (0, 3, 6)]
    read = lambda pages: numbers(paged.records(landed(spark, pages), RECORD, 3))
    assert read(whole) == list(range(8))
    assert read([*whole, (9, body([99], 8))]) == list(range(8))  # beyond the total
    assert read([whole[0], (3, None), whole[2]]) == [0, 1, 2]  # failed
    assert read([whole[0], (3, '{"data": [{"na'), whole[2]]) == [0, 1, 2]  # broken
    assert read([whole[0], whole[2]]) == [0, 1, 2]  # never landed
    assert read([whole[0], (3, body([], 8)), whole[2]]) == [0, 1, 2]  # empty
    assert read([(0, json.dumps({"data": [{"n": 5}]})), whole[1]]) == [5]  # no total: its own rows
    assert read([(0, body([], 8))]) == [] and read([]) == []


def test_a_failure_of_the_first_page_is_an_error(spark):
    for pages in ([(0, None), (3, body([3], 4))], [(3, body([3], 9))]):
        with pytest.raises(PySparkException, match="first page"):
            paged.records(landed(spark, pages), RECORD, 3).collect()


class Handler(BaseHTTPRequestHandler):
    fails_at: int | None = None

    def do_GET(self):
        asked = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
        start, length = asked["start"], asked["length"]
        if self.fails_at is not None and start >= self.fails_at:
            self.send_error(500)
            return
        data = body(range(start, min(start + length, 101)), 101).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    web = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=web.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{web.server_port}/rows"
    web.shutdown()
    Handler.fails_at = None


def test_rest_source(spark, server):
    spark.dataSource.register(paged.PagedRest)
    pages = spark.read.format("paged_rest").option("url", server).option("length", "10").option("pages_per_task", "3").load()
    assert pages.rdd.getNumPartitions() == 4 and pages.count() == 11
    assert numbers(paged.records(pages, RECORD, 10)) == list(range(101))
    Handler.fails_at = 40
    pages = spark.read.format("paged_rest").option("url", server).option("length", "10").option("pages_per_task", "3").load()
    assert {r["start"] for r in pages.where("error is not null").collect()} == {40, 60, 90}
    assert numbers(paged.records(pages, RECORD, 10)) == list(range(40))
    Handler.fails_at = 0
    with pytest.raises(PySparkException):
        spark.read.format("paged_rest").option("url", server).load().collect()


def test_submissions_and_documents(spark):
    rows = [(1, '{"sic": 3571, "sicDescription": " Electronic computers "}'), (2, '{"sic": "", "sicDescription": null}'), (3, "{"), (4, None)]
    got = {r["cik"]: r[1:] for r in paged.submissions(spark.createDataFrame(rows, "cik long, body string")).collect()}
    assert got == {1: ("3571", "Electronic computers", "Information Technology"), 2: (None, None, None), 3: (None, None, None), 4: (None, None, None)}
    doc = lambda n, t, d: {"title": t, "publication_date": d, "document_number": n, "agencies": [{"name": None, "raw_name": "A"}]}
    searches = [(1, json.dumps({"results": [doc("n1", "old", "2025-01-01"), doc(None, "x", "2025-02-30")]})), (2, json.dumps({"results": [doc("n1", "new", "2025-01-02")]})), (3, json.dumps({}))]
    found = sorted((r["number"] or "", r["title"], str(r["date"]), r["agencies"]) for r in paged.document_search(spark.createDataFrame(searches, "asked long, body string")).collect())
    assert found == [("", "x", "None", ["A"]), ("n1", "new", "2025-01-02", ["A"])]
