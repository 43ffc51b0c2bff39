from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import collocations as module
from tablewright.llm.catalog import QUERIES, SQL
from tests.comparison import connect, differences
from tests.llm.samples import FOLDER, SCHEMA, awkward, awkward_rows, needs_tables

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, longest=3, least=10, share=50, first=2000):
    counts: dict = defaultdict(Counter)
    total = Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    result = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    longer[p[k : k + size]] = max(longer[p[k : k + size]], a)
        kept = []
        for p, a in candidates.items():
            if p in longer and 100 * longer[p] >= share * a:
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:first], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return Counter(result)


def noise(seed, count, vocabulary=12):
    pick = random.Random(seed)
    words = ["Ab", "b", "é x", "d\x1ce", "F\x00g", "h-i", "'j'", "K", "ß", "\U0001f600", "m", "n"][:vocabulary]
    marks = [" ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\r", " ; "]
    return "".join(pick.choice(words) + pick.choice(marks) for _ in range(count))


def table():
    rows = awkward_rows()
    rows += [(50 + k, noise(k, 2_000), ("en", "fr", None)[k % 3], None, 0) for k in range(12)]
    rows += [(90, "a b " * 3_000, "xx", None, 0), (91, "a b c " * 40 + "." + "q a b " * 12, "xx", None, 0)]
    return rows


@pytest.mark.parametrize("longest", [2, 3, 5])
@pytest.mark.parametrize(("shard", "chunk"), [(1 << 21, 4 << 20), (64, 50)])
def test_against_brute_force(spark, monkeypatch, longest, shard, chunk):
    # Python workers import the module anew, so small sizes are tried on the functions themselves.
    rows = table()
    if shard < 1000:
        monkeypatch.setattr(module, "SHARD_WORDS", shard)
        monkeypatch.setattr(module, "CHUNK_BYTES", chunk)
        everything = np.full(1 << (module.BITS - 6), ~np.uint64(0))
        batch = module.pa.RecordBatch.from_arrays(
            [module.pa.array([r[2] or "und" for r in rows]), module.pa.array([(r[1] or "").encode() for r in rows])], names=["a", "b"]
        )
        for size in range(1, longest + 1):
            found = Counter()
            for part in module._count_shards(iter([batch]), size, type("Known", (), {"value": everything})):
                for lang, phrase, count in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    found[lang, phrase] += count
            brute = Counter()
            for _, text, lang, *_ in rows:
                for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
                    words = re.findall("[^ \t]+", piece)
                    brute.update((lang or "und", " ".join(words[k : k + size]).encode()) for k in range(len(words) - size + 1))
            assert found == brute
        return
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = Counter(map(tuple, module.collocations(docs, longest=longest).collect()))
    assert found == expected(rows, longest)
    assert len(found) > 100


def test_limits(spark):
    docs = spark.createDataFrame(table(), SCHEMA).repartition(2)
    found = Counter(map(tuple, module.collocations(docs, least=3, share=90, first=7).collect()))
    assert found == expected(table(), least=3, share=90, first=7)


def test_bits_that_are_set_in_error_change_nothing(spark, monkeypatch):
    everything = np.full(1 << (module.BITS - 6), ~np.uint64(0))
    monkeypatch.setattr(module, "_bitmap", lambda grams: everything)
    docs = spark.createDataFrame(table(), SCHEMA)
    assert Counter(map(tuple, module.collocations(docs).collect())) == expected(table())


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("x", "a b", 9_000_000_000_000, 2)], "lang string, phrase string, a long, size int")
    grams = spark.createDataFrame([("x", "a", 9_000_000_000_001), ("x", "b", 9_000_000_000_007)], "lang string, phrase string, count long")
    row = module._scored(phrases, grams).first()
    assert row.score == 10**6 * 9_000_000_000_000**2 // (9_000_000_000_001 * 9_000_000_000_007) == 999_999


def test_empty_table_and_clashing_columns(spark):
    assert module.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = awkward(spark).selectExpr("*", "1 AS phrase", "2 AS count", "3 AS a", "4 AS rank")
    assert Counter(map(tuple, module.collocations(docs).collect())) == expected(awkward_rows())


@needs_tables
def test_query(spark):
    with connect(FOLDER) as database:
        assert differences(QUERIES["op13_collocations"](spark, FOLDER), database, SQL["op13_collocations"]) == []
