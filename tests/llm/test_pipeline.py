"""Every stage against what its operator's brute-force version says of its own input."""

from __future__ import annotations

from collections import Counter

from tokenizers import Tokenizer

import corpus_pipeline
from tablewright.llm.tokens import default_tokenizer
from tests.llm import test_decontamination, test_near_duplicates, test_packing_and_counts, test_quality_rules, test_substring_dedup
from tests.llm.samples import FOLDER, SCHEMA, awkward, needs_tables


def rows_of(frame):
    return [tuple(row) for row in frame.collect()]


def check_stages(spark, docs, benchmark, folder):
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = rows_of(docs)
        docs = stage(spark, docs, folder)
        after = docs.collect()
        found = Counter(row[0] for row in after)
        if name == "quality":
            assert found == Counter(row[0] for row in before if test_quality_rules.expected(row)[0][-1])
        elif name == "near_dedup":
            groups = test_near_duplicates.expected(before)
            assert found == Counter({i: sum(n for (j, _, _), n in groups.items() if j == i) for i, _, c in groups if i == c})
        elif name == "substring_dedup":
            wanted = Counter((i, kept) for i, _, _, kept in test_substring_dedup.expected(before))
            assert Counter((row.doc_id, b" ".join((row.text or "").encode().split())) for row in after) == wanted
        elif name == "decontamination":
            items = [test_decontamination.words(x) for x in benchmark]
            grams = {tuple(x[k : k + 4]) for x in items for k in range(len(x) - 3)}

            def clean(text, items=items, grams=grams):
                doc = test_decontamination.words(text)
                near = any(tuple(doc[k : k + 4]) in grams for k in range(len(doc) - 3))
                return not near or not any(test_decontamination.overlap(doc, x) for x in items)

            assert found == Counter(row[0] for row in before if clean(row[1]))
        else:
            tokenizer = Tokenizer.from_file(default_tokenizer())
            documents = [(row[0], test_packing_and_counts.plain(tokenizer, row[1])) for row in before]
            test_packing_and_counts.check_packed(after, documents)
            continue
        assert docs.columns == columns
        docs = spark.createDataFrame(after, docs.schema) if after else docs.limit(0)
    return docs


def test_stages_are_the_asked_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "packing"]


@needs_tables
def test_awkward_rows(spark):
    benchmark = [row.text for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    check_stages(spark, awkward(spark), benchmark, FOLDER)
    check_stages(spark, spark.createDataFrame([], SCHEMA), benchmark, FOLDER)


@needs_tables
def test_run(spark):
    benchmark = [row.text for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    check_stages(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), benchmark, FOLDER)
    packed = corpus_pipeline.run(spark, FOLDER)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    assert packed.count() > 0
