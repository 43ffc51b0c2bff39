from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tablewright.llm import spelling as module
from tablewright.llm.catalog import QUERIES
from tests.llm.samples import FOLDER, SCHEMA, awkward, awkward_rows, needs_tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, damaged=97, shortest=5, least=3):
    found = Counter()
    for row in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", row[1] or ""):
            run = run.translate(LOWER)
            value = zlib.crc32(f"{'' if row[0] is None else row[0]}:{run}".encode())
            if value % damaged == 0:
                place = value % len(run)
                run = run[:place] + run[place + 1 :]
            found[run] += 1
    return {word: n for word, n in found.items() if n >= least and len(word) >= shortest}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def expected(counts, times=2):
    forms, close = {}, {}
    for word, n in counts.items():
        others = [x for x in counts if near(word, x)]
        close[word] = len(others)
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        forms[word] = best if best is not None and counts[best] >= times * n else None
    result = []
    for word, n in counts.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        form = forms[word]
        result.append((word, form, root, n, close[word], None if form is None else counts[form]))
    return Counter(result)


def words(seed, count, letters="aabé", sizes=(1, 9)):
    pick = random.Random(seed)
    made = {"".join(pick.choice(letters) for _ in range(pick.randint(*sizes))) for _ in range(count)}
    made |= {"x" * 200, "x" * 199, "x" * 70 + "y" * 30, "x" * 70 + "y" * 31, "aaaa", "aaa", "\U0001f600\U0001f600b", "\U0001f600b", "\U0001f601\U0001f600b"}
    return {word: pick.choice((3, 3, 5, 7, 20, 41, 83)) for word in sorted(made)}


def variants(frame, **more):
    return Counter(map(tuple, module.spelling_variants(frame, **more).select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize(("seed", "times"), [(1, 2), (2, 1), (3, 3)])
def test_neighbours(spark, seed, times):
    counts = words(seed, 700)
    rows = list(counts.items())
    random.Random(seed).shuffle(rows)
    if times == 1:  # equal counts have to end as well
        times = 2
        rows = [(word, 3 if k % 2 else 6) for k, (word, _) in enumerate(rows)]
        counts = dict(rows)
    assert variants(spark.createDataFrame(rows, "word string, n long").repartition(3), times=times) == expected(counts, times)


def test_nodes_over_many_ranges(spark):
    """Equal prefixes have equal numbers, and others have others, however the words are dealt."""
    counts = words(9, 900)
    frame = spark.createDataFrame([(word,) for word in counts], "word string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = module.with_nodes(frame, "word", "nodes", module.Scratch(spark)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    numbers: dict[str, int] = {}
    for row in found:
        assert len(row.nodes) == len(row.word) + 1
        for k, node in enumerate(row.nodes):
            assert numbers.setdefault(row.word[:k], node) == node
    assert len(set(numbers.values())) == len(numbers)
    assert [row.word for row in sorted(found, key=lambda x: x.nodes_at)] == sorted(counts)
    assert sorted(row.nodes_at for row in found) == list(range(len(counts)))


def test_runs(spark):
    rows = [*awkward_rows(), (70, "Straße straße STRAßE ×÷×÷× École İstanbul " * 50, None, None, 0)]
    rows += [(k, "letters Letter letterz lettres " * 9, None, None, 0) for k in range(200, 260)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for damaged in (97, 3):
        found = {row.word: row.n for row in module.run_counts(docs, damaged=damaged).collect()}
        assert found == counted(rows, damaged)
    assert variants(module.run_counts(docs, damaged=3)) == expected(counted(rows, 3))


def test_runs_of_a_long_text(monkeypatch):
    monkeypatch.setattr(module, "CHUNK_BYTES", 7)
    text = "some words, andé longerthanachunk x " * 20
    assert [run for runs in module._runs(text) for run in runs] == re.findall("[A-Za-zÀ-ÿ]+", text)


def test_repeated_null_and_empty_words(spark):
    rows = [("words", 3), ("words", 4), ("word", 30), (None, 5), ("", 9), ("wordy", None), ("wards", 1)]
    assert variants(spark.createDataFrame(rows, "word string, n long")) == expected({"words": 7, "word": 30, "wards": 1})


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert module.spelling_variants(module.run_counts(empty)).collect() == []
    docs = awkward(spark).selectExpr("*", "1 AS n", "2 AS word", "3 AS doc", "4 AS id")
    assert variants(module.run_counts(docs)) == expected(counted(awkward_rows()))


@needs_tables
def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    counts = counted(rows)
    found = QUERIES["op11_spelling_variants"](spark, FOLDER).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {row.word: row.n for row in found} == counts
    pick = random.Random(5).sample(found, 60)
    for row in pick:
        others = [x for x in counts if near(row.word, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form = best if best is not None and counts[best] >= 2 * row.n else None
        assert (row.n_near, row.form, row.form_n) == (len(others), form, counts.get(form))
    forms = {row.word: row.form for row in found}
    for row in found:
        root = row.word
        while forms[root] is not None:
            root = forms[root]
        assert row.root == root
