from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
import xxhash

from tablewright.llm import near_duplicates as module
from tablewright.llm.catalog import QUERIES
from tests.llm.samples import FOLDER, SCHEMA, awkward, awkward_rows, needs_tables


def simhash(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest reachable id of each node of a list of (id, fingerprint)."""
    values = np.array([p for _, p in prints], np.uint64)
    above = list(range(len(prints)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for k in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[k]) <= 3):
            above[top(k)] = top(int(j))
    least = {}
    for k, (identity, _) in enumerate(prints):
        known = [x for x in (least.get(top(k)), identity) if x is not None]
        least[top(k)] = min(known, default=None)
    return [least[top(k)] for k in range(len(prints))]


def expected(rows):
    prints = [(row[0], simhash(row[1])) for row in rows]
    return Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, components(prints), strict=True))


def test_awkward_rows(spark):
    found = module.near_duplicates(awkward(spark))
    assert Counter(map(tuple, found.collect())) == expected(awkward_rows())


def test_empty_table_and_clashing_columns(spark):
    assert module.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = awkward(spark).selectExpr("*", "1 AS print", "'x' AS component_id", "0 AS fingerprint", "2 AS kept_id", "3 AS utf8")
    assert module.near_duplicates(docs).count() == len(awkward_rows())
    assert module.keep_one_of_each(docs).columns == docs.columns


def test_one_of_each_group_stays(spark):
    kept = Counter(row[0] for row in module.keep_one_of_each(awkward(spark)).collect())
    groups = expected(awkward_rows())
    assert kept == Counter({i: sum(n for (j, _, c), n in groups.items() if j == i and c == i) for i, _, c in groups if i == c})


@pytest.mark.parametrize("seed", range(3))
def test_links_connect_what_is_three_bits_apart(spark, seed):
    random = np.random.default_rng(seed)
    prints = {0, (1 << 64) - 1}
    for start in random.integers(0, 1 << 63, 60, dtype=np.uint64).tolist():
        node = int(start)
        for _ in range(random.integers(1, 12)):  # chains and clouds of near fingerprints
            prints.add(node)
            for bit in random.integers(0, 64, random.integers(1, 6)).tolist():
                node ^= 1 << int(bit)
    nodes = sorted(prints)
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in nodes], "print long").repartition(3)
    wanted = components(list(enumerate(nodes)))
    place = {p: k for k, p in enumerate(nodes)}
    above = list(range(len(nodes)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in module.ball_links(frame).collect():
        a, b = (place[int(np.int64(x).view(np.uint64))] for x in (a, b))
        assert bin(nodes[a] ^ nodes[b]).count("1") <= 3
        above[max(top(a), top(b))] = min(top(a), top(b))
    assert [top(k) for k in range(len(nodes))] == wanted


@needs_tables
def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    assert Counter(map(tuple, QUERIES["op1_simhash"](spark, FOLDER).collect())) == expected(rows)
