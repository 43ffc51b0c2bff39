from __future__ import annotations

import subprocess
import sys
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from tablewright.llm import quality_rules as module
from tablewright.llm import texts
from tablewright.llm.catalog import QUERIES, SQL
from tests.comparison import connect, differences
from tests.llm.samples import FOLDER, SCHEMA, awkward, awkward_rows, needs_tables

SIZES = (5, 6, 7, 8, 9, 10)


def repeated(words, size, later_only):
    seen = Counter()
    total = Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1))
    inside = set()
    for k in range(len(words) - size + 1):
        gram = tuple(words[k : k + size])
        if seen[gram] if later_only else total[gram] > 1:
            inside.update(range(k, k + size))
        seen[gram] += 1
    return inside


def expected(row):
    text = (row[1] or "").encode()
    words = text.split()
    chars = [len(w.decode()) for w in words]
    lines = [x for x in text.split(b"\n") if x.strip()]
    later = [x for k, x in enumerate(lines) if x in lines[:k]]
    grams = [sum(chars[k] for k in repeated(words, n, True)) for n in SIZES]
    sizes = lambda found: sum(len(x.decode()) for x in found)
    counts = (len(words), sum(chars), sum(text.count(bytes([x])) for x in b"#*$%&|<>"), len(later), len(repeated(words, 3, False)))
    failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
    bad = any(x > 0.2 * counts[1] for x in grams) or sizes(later) > 0.2 * sizes(lines)
    return (row[0], *counts, failed, not failed and not bad), grams


def test_awkward_rows(spark, monkeypatch):
    for limit in (1, 500, 4 << 20):
        monkeypatch.setattr(texts, "SLICE_BYTES", limit)
        found = module.repetition_signals(awkward(spark).select("doc_id", "text"), "signals")
        failed, kept = module.quality_verdict("signals", module.RepetitionLimits())
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        rows = found.select("doc_id", *(F.col("signals")[x] for x in names), failed, kept, *(F.col("signals")[f"dup_{n}gram_chars"] for n in SIZES))
        wanted = Counter((*a, *b) for a, b in map(expected, awkward_rows()))
        assert Counter(map(tuple, rows.collect())) == wanted


def test_empty_table_and_clashing_columns(spark):
    assert module.keep_quality(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = awkward(spark).selectExpr("*", "1 AS signals", "2 AS utf8", "3 AS n_words")
    kept = module.keep_quality(docs)
    assert kept.columns == docs.columns
    assert Counter(row[0] for row in kept.collect()) == Counter(row[0] for row in awkward_rows() if expected(row)[0][-1])


@needs_tables
def test_query(spark):
    with connect(FOLDER) as database:
        assert differences(QUERIES["op7_quality_rules"](spark, FOLDER), database, SQL["op7_quality_rules"]) == []


def test_a_long_text_takes_a_bounded_multiple_of_itself():
    """Twelve bytes of a worker's memory for each byte of text at most."""
    script = """
import random, resource
from tablewright.llm import quality_rules
from tablewright.llm.texts import WordIds
pick = random.Random(1)
known = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(1, 9))) for _ in range(20_000)]
text = " ".join(pick.choices(known, k=2_700_000)).encode()
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
quality_rules._measure([text], (5, 6, 7, 8, 9, 10), WordIds())
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024 / len(text))
"""
    root = Path(__file__).resolve().parents[2]
    done = subprocess.run([sys.executable, "-c", script], cwd=root, capture_output=True, text=True, check=True)
    assert float(done.stdout) < 12
