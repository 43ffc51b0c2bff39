from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tablewright.llm import packing, token_counts
from tablewright.llm.catalog import QUERIES
from tablewright.llm.places import Scratch
from tablewright.llm.stores import Draft
from tablewright.llm.tokens import Encoder, default_tokenizer
from tests.llm.samples import FOLDER, SCHEMA, awkward, awkward_rows, needs_tables


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def check_packed(rows, documents, size=1024):
    """Documents in full, pieces of the right lengths, sequences without gaps; gives their number."""
    by_document, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_document[row.doc_id].append(row)
        by_sequence[row.sequence_id].append((row.offset, row.length))
    wanted, found = Counter(), Counter()
    for identity, ids in documents:
        ids = [*ids, 2]
        bounds = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
        for piece, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
            wanted[identity, piece, x, y - x, zlib.crc32(np.array(ids[x:y], "<u4").tobytes())] += 1
    for identity, own in by_document.items():
        for row in own:
            crc = row.ids_crc32 if "ids_crc32" in row else zlib.crc32(row.ids)
            found[identity, row.piece, row.start, row.length, crc] += 1
    assert found == wanted
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= size
    return len(by_sequence)


def test_encoder_gives_the_tokenizers_ids(tokenizer):
    pick = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "a", "é", "1", ".", " ", "'s", "\x1c", "<|endoftext|>", "ab", "\x85", "!", "\r", "﻿", "漢", " "]
    texts = ["".join(pick.choice(bits) for _ in range(pick.randint(0, 14))) for _ in range(5_000)]
    encoder = Encoder(default_tokenizer())
    for first in range(0, len(texts), 700):
        some = texts[first : first + 700]
        found = encoder.encode([x.encode() for x in some])
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [plain(tokenizer, x) for x in some]


def test_latin_texts_and_literal_special_tokens(tokenizer):
    fast = Encoder(default_tokenizer())
    assert fast._fast is not None
    pick = random.Random(6)
    texts = ["".join(chr(pick.choice([pick.randrange(256), 32, 10, 97])) for _ in range(40)) for _ in range(3_000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in fast.encode([x.encode() for x in texts])] == [plain(tokenizer, x) for x in texts]
    literal = Encoder(default_tokenizer(), "<u2", literal=True)
    assert 50256 not in np.frombuffer(literal.encode(["a<|endoftext|>b 漢".encode()])[0], "<u2")


def test_open_bins_take_the_tightest_and_close_the_fullest():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 10)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 8, 5)] == [(0, 0), (1, 0), (2, 0)]  # bin 1 closes
    assert bins.place(2) == (0, 6)  # the tightest still open is full now but for two
    assert bins.place(2) == (0, 8)


def test_packing_awkward_rows(spark, tokenizer):
    for size in (16, 1024):
        rows = packing.pack_documents(awkward(spark), size=size).collect()
        check_packed(rows, [(row[0], plain(tokenizer, row[1])) for row in awkward_rows()], size)


def test_few_open_bins(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "OPEN_BINS", 2)
    monkeypatch.setattr(packing, "DOCUMENTS", 7)
    rows = packing.pack_documents(awkward(spark), size=64).collect()
    check_packed(rows, [(row[0], plain(tokenizer, row[1])) for row in awkward_rows()], 64)


def test_empty_tables_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert packing.pack_documents(empty).collect() == []
    assert token_counts.count_document_tokens(empty).collect() == []
    docs = awkward(spark).selectExpr("*", "1 AS ids", "2 AS task", "3 AS piece", "4 AS file", "5 AS number")
    assert packing.pack_documents(docs).count() > 0
    assert token_counts.count_document_tokens(docs).count() == len(awkward_rows())


def test_counts_of_awkward_rows(spark, tokenizer):
    tokenizer.encode_special_tokens = True
    wanted = Counter((row[0], len(plain(tokenizer, row[1]))) for row in awkward_rows())
    tokenizer.encode_special_tokens = False
    found = token_counts.count_document_tokens(awkward(spark))
    assert Counter((row.doc_id, row.n_tokens) for row in found.collect()) == wanted


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
@pytest.mark.parametrize("block", [8, 24, 1 << 20])
def test_boundaries_are_stitched(spark, kind, block):
    pick = random.Random(7)
    folder = Scratch(spark).folder("flat")
    wanted, files = Counter(), []
    shapes = [[], [9], [1], [9, 9, 9], [1] * 50, [9, *[1] * 40, 9], [*[1] * 33, 9], [pick.choice([1, 2, 9]) for _ in range(300)]]
    for k, ids in enumerate(shapes):
        draft = Draft(folder, f"f{k}")
        draft.write(np.array(ids, kind).tobytes())
        draft.commit()
        files.append((f"f{k}", draft.size))
        start = number = 0
        for at, one in enumerate([*ids, None]):
            if one == 9 or (one is None and at > start):
                wanted[f"f{k}", number, start, at - start] += 1
                start, number = at + 1, number + 1
    frame = spark.createDataFrame(files, "file string, bytes long")
    found = token_counts.token_counts(frame, folder, end=9, kind=kind, block=block)
    assert Counter(map(tuple, found.select("file", "number", "start", "n_tokens").collect())) == wanted


def test_a_block_of_a_million_documents(spark):
    """Nothing but separators in one block: rows and memory grow with the documents, not with their square."""
    folder = Scratch(spark).folder("separators")
    draft = Draft(folder, "f")
    draft.write(np.full(1_000_000, 9, "<u2").tobytes())
    draft.commit()
    files = spark.createDataFrame([("f", draft.size)], "file string, bytes long")
    found = token_counts.token_counts(files, folder, end=9).selectExpr(
        "count(*)", "count(DISTINCT number)", "max(number)", "sum(n_tokens)", "count_if(start <> number)"
    )
    assert tuple(found.first()) == (1_000_000, 1_000_000, 999_999, 0, 0)


def test_files_roll(spark):
    scratch = Scratch(spark)
    folder = scratch.folder("rolled")
    written = scratch.keep(token_counts.write_token_files(awkward(spark), folder, roll=1000), "names")
    files = written.groupBy("file").agg({"bytes": "max"}).toDF("file", "bytes")
    assert files.count() > 5
    assert token_counts.token_counts(files, folder).count() == len(awkward_rows())


@needs_tables
def test_queries(spark, tokenizer):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    ids = [(row.doc_id, plain(tokenizer, row.text)) for row in docs]
    sequences = check_packed(QUERIES["op2_best_fit_packing"](spark, FOLDER).collect(), ids)
    assert sequences <= 1.02 * sum(len(x) + 1 for _, x in ids) / 1024 + 1
    counts = QUERIES["op5_token_counts"](spark, FOLDER).collect()
    assert Counter((row.doc_id, row.n_tokens) for row in counts) == Counter((i, len(x)) for i, x in ids)
