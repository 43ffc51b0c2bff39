"""Small documents with the awkward cases: nulls, empties, long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> list[str]:
    pick = random.Random(seed)
    return ["".join(pick.choice("abcdefghijklmnop") for _ in range(pick.randint(1, 7))) for _ in range(words)]


def awkward_rows() -> list[tuple]:
    passage = prose(1, 70)
    long = prose(2, 30_000)
    texts = {
        0: " ".join(prose(3, 120)),
        1: None,
        2: "",
        3: " \t\n ",
        4: "one",
        5: "two words",
        6: " ".join(prose(4, 30) + passage + prose(5, 40)),
        7: " ".join(prose(6, 11) + passage + prose(7, 3)),
        8: "\n".join(passage),
        9: " ".join(long),
        10: " ".join(prose(8, 200) + long[5_000:5_200] + prose(9, 20)),
        11: " ".join(prose(3, 120)),
        12: "é ü ñ " * 40,
        13: " ".join(["same"] * 300),
        14: " ".join(["same"] * 200),
        15: "The Same LINE again here\n" * 20 + " ".join(prose(10, 60)),
        16: " ".join(prose(3, 119) + ["changed"]),
    }
    rows = [(key, text, "en", "src", len(text or "")) for key, text in texts.items()]
    rows += [rows[6], rows[0], (6, " ".join(prose(11, 10) + passage), None, None, None)]  # repeated rows and ids
    rows += [(None, " ".join(passage), None, None, 3), (None, None, None, None, None), (None, " ".join(prose(3, 120)), "en", "src", 1)]
    return rows


def awkward(spark, partitions: int = 5):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(partitions)
