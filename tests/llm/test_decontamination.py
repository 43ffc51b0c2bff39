from __future__ import annotations

import itertools
import string
from collections import Counter

import pytest

from tablewright.llm import decontamination as module
from tablewright.llm.catalog import QUERIES
from tests.llm.samples import FOLDER, SCHEMA, awkward, awkward_rows, needs_tables, prose

ITEMS = "item_id long, text string"


def words(text):
    return [w.lower().strip(string.punctuation.encode()) or w for w in (text or "").encode().split()]


def overlap(doc, item):
    """First and last word and most equal words of the overlaps of two lists of words; None without one."""
    if len(item) < 5:
        return None
    size = min(13, len(item))
    need = 11 if size == 13 else size
    if size < 13:
        size = len(item)
    found = []
    for shift in range(-len(item) + 1, len(doc)):
        equal = [0 <= shift + k < len(doc) and doc[shift + k] == item[k] for k in range(len(item))]
        for k in range(len(item) - size + 1):
            if sum(equal[k : k + size]) >= need and any(equal[k : k + size]):
                found.append((shift + k, shift + k + size - 1, sum(equal[k : k + size])))
    return (min(x[0] for x in found), max(x[1] for x in found), max(x[2] for x in found)) if found else None


def test_masks_find_every_two_substitutions():
    placed = [sum(1 << (at + k) for k in mask) for mask in module.MASKS for at in range(13 - mask[-1])]
    for changed in itertools.combinations(range(13), 2):
        bits = sum(1 << k for k in changed)
        assert any(not mask & bits for mask in placed)


@pytest.fixture
def planted(spark):
    item = prose(50, 30)
    short = prose(51, 7)
    changed = list(item)
    changed[4] = changed[11] = changed[18] = changed[25] = "other"
    texts = [
        prose(60, 40) + item + prose(61, 5),
        prose(62, 3) + changed + prose(63, 9),
        ["(" + w.upper() + ")," for w in item],
        item[8:21],
        item[8:20],
        prose(64, 10) + item[:6] + ["x"] + item[6:12] + prose(65, 10),
        [*item[2:6], "x", *item[7:13], "y", item[14]],
        [*item[2:6], "x", *item[7:12], "z", "y", item[14]],
        prose(66, 9) + short + prose(67, 2),
        prose(66, 9) + short[:-1] + prose(67, 2),
        prose(68, 60),
        item + prose(69, 5) + item,
    ]
    docs = [(k, " ".join(text), "", "", 0) for k, text in enumerate(texts)]
    items = [(0, " ".join(item)), (1, " ".join(short)), (2, "too short"), (3, None), (4, ""), (None, " ".join(prose(64, 20))), (0, " ".join(item))]
    return docs, items


def expected(docs, items):
    out = set()
    for doc, item in itertools.product(docs, items):
        if found := overlap(words(doc[1]), words(item[1])):
            out.add((doc[0], item[0], found))
    return out


def test_planted_overlaps(spark, planted):
    docs, items = planted
    frame = module.contaminations(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(items, ITEMS))
    found = {(r.doc_id, r.item_id, (r.first_word, r.last_word, r.n_equal)) for r in frame.collect()}
    wanted = expected(docs, items)
    assert {x[:2] for x in found} == {x[:2] for x in wanted}
    assert {x for x in found if x[0] != 11} == {x for x in wanted if x[0] != 11}


def test_a_full_bitmap_changes_nothing(spark, planted, monkeypatch):
    monkeypatch.setattr(module, "BITS", 6)
    docs, items = planted
    frame = module.contaminations(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS))
    assert {(r.doc_id, r.item_id) for r in frame.collect()} == {x[:2] for x in expected(docs, items)}


def test_awkward_rows_and_empty_tables(spark):
    items = [(1, awkward_rows()[0][1]), (2, " ".join(["same"] * 20)), (3, None)]
    benchmark = spark.createDataFrame(items, ITEMS)
    docs = awkward(spark).selectExpr("*", "1 AS key", "2 AS hash", "3 AS of", "4 AS item_id", "5 AS around")
    found = module.contaminations(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {x[:2] for x in expected(awkward_rows(), items)}
    kept = module.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns
    bad = Counter(r[0] for r in awkward_rows() if any(overlap(words(r[1]), words(t)) for _, t in items))
    assert Counter(r[0] for r in kept.collect()) == Counter(r[0] for r in awkward_rows()) - bad
    assert module.contaminations(spark.createDataFrame([], SCHEMA), benchmark).collect() == []
    assert module.decontaminate(awkward(spark), spark.createDataFrame([], ITEMS)).count() == len(awkward_rows())


@needs_tables
def test_query(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()
    split = [(i, words(t)) for i, t in items]
    wanted = set()
    for identity, text in docs:
        doc = words(text)
        grams = {tuple(doc[k : k + 3]) for k in range(len(doc) - 2)}
        for item, other in split:  # two of 13 words differ: four in a row are equal
            if any(tuple(other[k : k + 3]) in grams for k in range(len(other) - 2)) and overlap(doc, other):
                wanted.add((identity, item))
    assert {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"](spark, FOLDER).collect()} == wanted
