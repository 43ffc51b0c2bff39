"""Quality rules on repetition: how much of a text lies in repeated n-grams and lines.

Rolling hashes of several n-gram lengths mark every n-gram that occurs again in its text;
what is measured is the share of the words' characters inside the marked ones, so
overlapping n-grams count once. The first occurrence of an n-gram or line is no repetition.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.places import fresh_name, quoted
from tablewright.llm.texts import WordIds, map_texts, mixed, rolled, word_ids

SYMBOLS = b"#*$%&|<>"
#: Windows whose repetition ``n_repeat_words`` counts.
REPEAT_WINDOW = 3


@dataclass(frozen=True)
class RepetitionLimits:
    """The largest shares of characters a kept text may have in repetitions.

    Published rules start at 0.10 to 0.15 and also limit the number of repeated lines;
    that rejects sound short texts for one line said twice. With a fifth, the shortest
    text that is kept may repeat one line of nine words.
    """

    ngrams: Mapping[int, float] = field(default_factory=lambda: dict.fromkeys(range(5, 11), 0.20))
    line_chars: float = 0.20
    min_words: int = 50
    repeat_words: float = 0.50


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "dup_line_chars")


def _signals_type(sizes: tuple[int, ...]) -> T.StructType:
    names = [*_COUNTS, *(f"dup_{n}gram_chars" for n in sizes)]
    return T.StructType([T.StructField(name, T.LongType()) for name in names])


def repetition_signals(docs: DataFrame, name: str, text: str = "text", sizes: tuple[int, ...] = (5, 6, 7, 8, 9, 10)) -> DataFrame:
    """``docs`` with a struct column of counts for each row; no shuffle.

    Words are runs of bytes other than space and \\t to \\r. A null or empty text has no
    words, and every count of it is 0. Texts are read whole; rows that repeat count alike.
    """
    sizes = tuple(sorted(sizes))
    ids = WordIds()
    return map_texts(docs, text, name, _signals_type(sizes), lambda texts: _measure(texts, sizes, ids))


def quality_verdict(signals: str, limits: RepetitionLimits) -> tuple[Column, Column]:
    """``base_failed`` and ``kept`` from a column made by ``repetition_signals``."""
    value = lambda x: quoted(signals)[x]
    failed = (value("n_words") < limits.min_words) | (value("n_repeat_words") > limits.repeat_words * value("n_words"))
    repeated = [value(f"dup_{n}gram_chars") > share * value("word_chars") for n, share in sorted(limits.ngrams.items())]
    repeated.append(value("dup_line_chars") > limits.line_chars * value("line_chars"))
    verdict = ~failed
    for rule in repeated:
        verdict = verdict & ~rule
    return failed, verdict


def keep_quality(docs: DataFrame, text: str = "text", limits: RepetitionLimits | None = None) -> DataFrame:
    """The rows of ``docs`` that pass all rules, with the columns they had."""
    limits = limits or RepetitionLimits()
    name = fresh_name(docs, "signals")
    measured = repetition_signals(docs, name, text, tuple(limits.ngrams))
    return measured.where(quality_verdict(name, limits)[1]).drop(name)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _measure(texts: list[bytes], sizes: tuple[int, ...], ids: WordIds) -> list[np.ndarray]:
    flat, bounds = word_ids([text.split() for text in texts], ids)
    count = np.diff(bounds)
    length, symbols = _characters(texts, len(flat))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), count)
    columns = {
        "n_words": count,
        "word_chars": np.bincount(owner, length, minlength=len(texts)),
        "n_symbols": symbols,
    }
    columns |= _lines(texts)
    left = np.repeat(bounds[1:], count) - np.arange(len(flat))  # words to the end of the text
    place, again = _repeats(flat, owner, left, REPEAT_WINDOW, None)
    both = place[again != 1]
    columns["n_repeat_words"] = _covered(both, REPEAT_WINDOW, np.ones(len(flat), np.int8), owner, len(texts))
    # A longer n-gram can only occur again where its first three words do.
    for size in sizes:
        place, again = _repeats(flat, owner, left, size, place if size > REPEAT_WINDOW else None)
        columns[f"dup_{size}gram_chars"] = _covered(place[again == 2], size, length, owner, len(texts))
    return [np.asarray(columns[x], np.int64) for x in _signals_type(sizes).names]


def _characters(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each word of all texts, and symbols of each text."""
    lengths = np.zeros(words, np.int32)
    symbols = np.zeros(len(texts), np.int64)
    done = 0
    for k, text in enumerate(texts):
        data = np.frombuffer(text, np.uint8)
        symbols[k] = np.count_nonzero(_SYMBOL[data])
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~_SPACE[data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32)
        starts, ends = edges[::2], edges[1::2]
        own = lengths[done : done + len(starts)]
        own[:] = ends - starts
        if not text.isascii():
            # Bytes that continue a code point count for the word they are in.
            later = np.flatnonzero(_CONTINUES[data]).astype(np.int32)
            own -= (np.searchsorted(later, ends) - np.searchsorted(later, starts)).astype(np.int32)
        done += len(starts)
    assert done == words
    return lengths, symbols


def _lines(texts: list[bytes]) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {"n_dup_lines": [], "line_chars": [], "dup_line_chars": []}
    for text in texts:
        lines = [line for line in text.split(b"\n") if line.strip()]
        distinct = set(lines)
        total = repeated = 0
        if len(distinct) < len(lines):
            sizes = {line: len(line.decode("utf-8", "replace")) for line in distinct}
            total = sum(sizes[line] for line in lines)
            repeated = total - sum(sizes.values())
        for key, value in zip(found, (len(lines) - len(distinct), total, repeated), strict=True):
            found[key].append(value)
    return found


def _repeats(
    flat: np.ndarray, owner: np.ndarray, left: np.ndarray, size: int, among: np.ndarray | None
) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start that occur again in their text, and 0 or 2 with each: first or later occurrence.

    ``among`` are the only places to look at.
    """
    hashes = rolled(flat, size)
    places = np.flatnonzero(left[: len(hashes)] >= size).astype(np.int32) if among is None else among[left[among] >= size]
    if not len(places):
        return places, places
    keys = mixed(hashes[places] + mixed(owner[places].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    later = np.zeros(len(places), bool)
    later[order[1:][same]] = True
    first = np.zeros(len(places), bool)
    first[order[:-1][same]] = True
    first &= ~later
    found = first | later
    return places[found], np.where(later, np.int8(2), np.int8(0))[found]


def _covered(places: np.ndarray, size: int, weight: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """Per text, the weight of the words inside the windows that start at ``places``."""
    change = np.zeros(len(owner) + 1, np.int32)
    np.add.at(change, places, 1)
    np.add.at(change, places + size, -1)
    inside = np.cumsum(change[:-1]) > 0
    return np.bincount(owner[inside], weight[inside], minlength=texts).astype(np.int64)
