from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

from tablewright.llm import substring_dedup as module
from tablewright.llm.catalog import QUERIES, SQL
from tests.comparison import connect, differences
from tests.llm.samples import FOLDER, SCHEMA, awkward, awkward_rows, needs_tables, prose

LAST = 1 << 62


def expected(rows, window=50):
    first = defaultdict(lambda: LAST + 1)
    words = [(row[1] or "").encode().split() for row in rows]
    ids = [LAST if row[0] is None else row[0] for row in rows]
    for who, text in zip(ids, words, strict=True):
        for k in range(len(text) - window + 1):
            key = tuple(text[k : k + window])
            first[key] = min(first[key], who)
    out = []
    for row, who, text in zip(rows, ids, words, strict=True):
        gone = set()
        for k in range(len(text) - window + 1):
            if first[tuple(text[k : k + window])] < who:
                gone.update(range(k, k + window))
        kept = b" ".join(w for k, w in enumerate(text) if k not in gone)
        out.append((row[0], len(text), len(gone), kept))
    return out


@pytest.mark.parametrize("slice_bytes", [1, 1000, 1 << 24])
def test_awkward_rows(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(module, "_SLICE", slice_bytes)
    monkeypatch.setattr(module, "BUCKET_BYTES", 20_000)
    found = module.removed_words(awkward(spark))
    assert Counter((i, n, r, bytes(k)) for i, n, r, k in found.collect()) == Counter(expected(awkward_rows()))


@pytest.mark.parametrize("partitions", [1, 7])
def test_many_overlapping_passages(spark, monkeypatch, partitions):
    monkeypatch.setattr(module, "_SLICE", 2_000)
    base = prose(20, 2_000)
    rows = [(k, " ".join(prose(100 + k, k % 9) + base[37 * k % 1900 : 37 * k % 1900 + 60 + k] + prose(300 + k, 5)), "", "", 0) for k in range(90)]
    found = module.removed_words(spark.createDataFrame(rows, SCHEMA).repartition(partitions), window=50)
    assert Counter((i, n, r, bytes(k)) for i, n, r, k in found.collect()) == Counter(expected(rows))


@pytest.mark.parametrize("slice_bytes", [1, 1 << 24])
def test_repeated_rows_that_lose_words_stay_as_many(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(module, "_SLICE", slice_bytes)
    passage = prose(40, 60)
    text = " ".join(prose(41, 5) + passage)
    rows = [(1, " ".join(passage), "", "", 0)] + [(7, text, "", "", 0)] * 3 + [(None, text, "", "", 0)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = module.removed_words(docs)
    assert Counter((i, n, r, bytes(k)) for i, n, r, k in found.collect()) == Counter(expected(rows))
    assert Counter(row.doc_id for row in module.drop_repeats(docs).collect()) == {1: 1, 7: 3, None: 2}


def test_empty_table_and_clashing_columns(spark):
    assert module.removed_words(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = awkward(spark).selectExpr("*", "1 AS spans", "2 AS key", "3 AS row_key", "4 AS shortened", "5 AS id")
    assert module.drop_repeats(docs).columns == docs.columns
    assert module.drop_repeats(docs).count() == len(awkward_rows())


def test_texts_without_repeats_stay_as_they_are(spark):
    before = {(r[0], r[1]) for r in awkward_rows()}
    words = {(i, kept) for i, _, _, kept in expected(awkward_rows())}
    for row in module.drop_repeats(awkward(spark)).collect():
        assert (row.doc_id, b" ".join((row.text or "").encode().split())) in words
        assert (row.doc_id, row.text) in before or row.n_chars == len(row.text)


def test_cut_keeps_the_white_space_before_kept_words():
    assert module._cut(b" a b\n c  d ", [{"first": 1, "last": 3}]) == b" a  d "
    assert module._cut(b"a b", [{"first": 0, "last": 2}]) == b""
    assert module._cut(b"a b\tc\n", [{"first": 0, "last": 1}, {"first": 2, "last": 3}]) == b" b\n"


@needs_tables
def test_query(spark):
    frame = QUERIES["op3_substring_dedup"](spark, FOLDER)
    with connect(FOLDER) as database:
        assert differences(frame, database, SQL["op3_substring_dedup"]) == []
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    wanted = Counter((i, n, r, hashlib.sha256(k).hexdigest()) for i, n, r, k in expected(rows))
    assert Counter(map(tuple, frame.collect())) == wanted
