from __future__ import annotations

import gzip
import io
from collections import Counter, defaultdict

import pytest

from tablewright.llm import warc as module
from tablewright.llm.catalog import QUERIES, SQL
from tablewright.llm.places import Scratch
from tablewright.llm.stores import open_store
from tests.comparison import connect, differences
from tests.llm.samples import FOLDER, needs_tables

PAGES = "page_id long, url string, html string"
ROWS = [
    (1, "http://a.example/1", "<p>same</p>"),
    (2, "http://a.example/2", "<p>same</p>"),
    (9, "http://b.example/ü ?x=\r\nWARC-Type: bad", "<p>same</p>"),
    (3, None, None),
    (4, "", ""),
    (5, "http://a.example/5", "one\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"),
    (6, "http://a.example/6", "é漢" * 40_000),
    (None, "http://a.example/none", "<p>same</p>"),
    (None, "http://a.example/none", "only without id"),
    (None, "http://a.example/none", "only without id"),
    (7, "http://a.example/7", "twice"),
    (7, "http://a.example/7", "twice"),
]


def expected(rows, least=0):
    largest = defaultdict(list)
    for identity, _, html in rows:
        largest[html or ""].append(identity)
    out = Counter()
    for identity, url, html in rows:
        data = (html or "").encode()
        same = [x for x in largest[html or ""] if x is not None]
        revisit = len(data) >= least and same and identity != max(same)
        kind, to = ("revisit", max(same)) if revisit else ("response", None)
        out[identity, len(data), module.payload_digest(data), kind, to] += 1
    return out


def found(frame):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in frame.collect())


@pytest.mark.parametrize("least", [0, 1, 12])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, PAGES).repartition(4)
    back = module.archive_pages(pages, least=least)
    assert found(back) == expected(ROWS, least)
    texts = Counter((r.page_id, bytes(r.payload)) for r in back.collect() if r.record_type == "response")
    assert all((i, (h or "").encode()) in texts or k == "revisit" for (i, _, h), k in [(r, "") for r in ROWS if (r[0], (r[2] or "").encode()) in texts])


def test_files_come_out_the_same_and_roll(spark, monkeypatch):
    monkeypatch.setattr(module, "SHARD", 5)
    sums = []
    for partitions in (1, 3):
        folder = Scratch(spark).folder("again")
        manifest = module.write_warc(spark.createDataFrame(ROWS, PAGES).repartition(partitions), folder, roll=600)
        rows = sorted(map(tuple, manifest.collect()))
        assert len(rows) > 3 and sum(row[1] for row in rows) == len(ROWS)
        sums.append(rows)
        store, base = open_store(folder)
        with store.open_input_stream(f"{base}/{rows[0][0]}", compression=None) as raw:
            data = raw.read()
        assert len(data) == rows[0][2]
        kinds = [headers["warc-type"] for headers, _ in module.records(io.BytesIO(gzip.decompress(data)))]
        assert kinds[0] == "warcinfo" and len(kinds) == rows[0][1] + 1
    assert sums[0] == sums[1]


def test_a_torn_file_is_an_error():
    whole = gzip.decompress(module._record(1, "u", b"x" * 100, b"\0" * 20, None, "2000-01-01T00:00:00Z", 0))
    with pytest.raises(ValueError, match="not whole"):
        list(module.records(io.BytesIO(whole[:-30])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(module.records(io.BytesIO(b"x" + whole)))


def test_empty_table_and_clashing_columns(spark):
    assert module.archive_pages(spark.createDataFrame([], PAGES)).collect() == []
    pages = spark.createDataFrame(ROWS, PAGES).selectExpr("*", "1 AS id", "2 AS digest", "3 AS refers_to", "4 AS of", "5 AS shard")
    assert found(module.archive_pages(pages)) == expected(ROWS)


@needs_tables
def test_query(spark):
    with connect(FOLDER) as database:
        assert differences(QUERIES["op8_warc"](spark, FOLDER), database, SQL["op8_warc"]) == []
