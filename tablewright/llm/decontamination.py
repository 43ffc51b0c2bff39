"""Benchmark decontamination by spaced seeds, which look past substituted words.

A mask selects some words of a short stretch and ignores the others, so a passage in
which ignored words were exchanged still has the same hash. The masks below are chosen
so that any 13 words with at most two exchanged ones agree with the original under one
of them somewhere: no such overlap is missed. Test and training hashes are joined, and
around each hit the words are compared one by one.

Training text has a few hashes a word; a bitmap of fixed size, made of the benchmark's
hashes, keeps those that cannot meet any out of the shuffle. It only saves work: with a
benchmark too large for it, more hashes are shuffled and the join finds the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.places import Scratch, quoted
from tablewright.llm.substring_dedup import row_key
from tablewright.llm.texts import WordIds, mixed, rolled, slices, utf8, word_ids

#: Words of an overlap, and how many of them may differ: 11 of 13 are more than 0.8.
OVERLAP = 13
SUBSTITUTIONS = 2
MASKS = ((0, 1, 2, 5, 6, 7, 8), (0, 1, 2, 3, 6, 9, 10), (0, 2, 3, 4, 5, 6, 7))
#: Items with fewer words than an overlap must occur as they are; with fewer than these they are no evidence.
LEAST_WORDS = 5
#: Bits of the bitmap: 4 MB on every worker.
BITS = 25
#: Words before and after the first word of a hit that are compared.
_BEFORE = OVERLAP - 1
_AROUND = 2 * OVERLAP - 1
_PUNCTUATION = bytes(x for x in range(33, 127) if not chr(x).isalnum())
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _PlainWords(WordIds):
    """Ids of words without case and the punctuation around them."""

    def __missing__(self, word: bytes) -> int:
        plain = word.lower().strip(_PUNCTUATION) or word
        value = super().__missing__(plain) if plain not in self else self[plain]
        self[word] = value
        return value


def contaminations(
    docs: DataFrame,
    benchmark: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id key item_id first_word last_word n_equal`` for each document and item that overlap.

    An overlap is 13 words of an item of which at most two differ from the words at the
    same places of the document, case and punctuation around words aside. Items of 5 to 12
    words have to occur as they are, shorter ones are ignored. ``first_word`` and
    ``last_word`` span the overlaps in the document, ``n_equal`` is the most equal words
    that one of them has. ``key`` tells rows apart that share an identity. Null and empty
    texts overlap with nothing; repeated rows and items give one row.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    items = benchmark.select(quoted(item).alias("item_id"), utf8(quoted(item_text)).alias("words"))
    seeds = items.mapInArrow(_item_seeds, "item_id " + items.schema["item_id"].dataType.simpleString() + ", hash long, size int, around binary")
    seeds = scratch.keep(seeds.distinct(), "seeds")
    short = sorted(row.size for row in seeds.where(F.col("size") < OVERLAP).select("size").distinct().collect())  # eight at most
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds))
    rows = docs.select(quoted(identity).alias("doc_id"), row_key(identity, text).alias("key"), utf8(quoted(text)).alias("words"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, hash long, word long, around binary"
    hits = rows.mapInArrow(lambda batches: _hits(batches, bitmap, short), kind)
    met = hits.join(seeds.withColumnRenamed("around", "item_around"), "hash")
    verified = met.select("doc_id", "key", "word", "around", "item_id", "size", "item_around").mapInArrow(
        _verify, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long, item_id {items.schema['item_id'].dataType.simpleString()}, "
        "first_word long, last_word long, n_equal int",
    )
    return verified.groupBy("doc_id", "key", "item_id").agg(
        F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("n_equal").alias("n_equal")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, identity: str = "doc_id", text: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs`` that overlap with no benchmark item, with the columns they had."""
    found = contaminations(docs, benchmark, identity, text, **names).select(F.col("doc_id").alias("of"), F.col("key").alias("of_key")).distinct()
    found = Scratch(docs.sparkSession).keep(found, "contaminated")
    same = (row_key(identity, text) == found["of_key"]) & quoted(identity).eqNullSafe(found["of"])
    return docs.join(found, same, "left_anti")


def _seed_hashes(flat: np.ndarray, short: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """Span, size of the overlap and the hash at each place: one for each mask, one for each short length."""
    for number, mask in enumerate(MASKS):
        span = mask[-1] + 1
        if len(flat) < span:
            continue
        count = len(flat) - span + 1
        total = np.full(count, number + 1, np.uint64)
        with np.errstate(over="ignore"):
            for offset in mask:
                total = total * _FACTOR + flat[offset : offset + count]
        yield span, OVERLAP, mixed(total)
    for size in short:
        if len(flat) >= size:
            yield size, size, mixed(rolled(flat, size) + np.uint64(size))


def _around(flat: np.ndarray, bounds: np.ndarray, owner: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The word ids from 12 before each place to 12 behind it; 0 beyond the text."""
    at = places[:, None] + np.arange(-_BEFORE, _AROUND - _BEFORE)
    inside = (at >= bounds[owner[places]][:, None]) & (at < bounds[owner[places] + 1][:, None])
    return np.where(inside, flat[np.clip(at, 0, len(flat) - 1)], np.uint64(0))


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids = _PlainWords()
    for batch in batches:
        for rows in slices(batch, 1):
            flat, bounds = word_ids([x.split() for x in rows.column(1).to_pylist()], ids)
            count = np.diff(bounds)
            owner = np.repeat(np.arange(len(count)), count)
            lengths = sorted({int(n) for n in count if LEAST_WORDS <= n < OVERLAP})
            out = []
            for span, size, hashes in _seed_hashes(flat, lengths):
                places = np.arange(len(hashes))
                whole = owner[places] == owner[places + span - 1]
                fits = count[owner[places]] >= OVERLAP if size == OVERLAP else count[owner[places]] == size
                places = places[whole & fits]
                if len(places):
                    out.append((owner[places], hashes[places], np.full(len(places), size), _around(flat, bounds, owner, places)))
            for own, hashes, sizes, around in out:
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(own)),
                        pa.array(hashes.view(np.int64)),
                        pa.array(sizes.astype(np.int32)),
                        pa.array([x.tobytes() for x in around], pa.binary()),
                    ],
                    names=["item_id", "hash", "size", "around"],
                )


def _bit_places(hashes: np.ndarray, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a hash in a bitmap of 32-bit words."""
    most = np.uint64(len(bitmap) * 32 - 1)
    return hashes & most, (hashes >> np.uint64(int(most).bit_length())) & most


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """The bitmap of all seeds, joined on the executors; at most 2^25 bits come to the driver."""
    most = (1 << BITS) - 1
    bit = F.explode(F.array(F.col("hash").bitwiseAND(most), F.shiftrightunsigned("hash", BITS).bitwiseAND(most)))
    words = seeds.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 AS int))")).alias("bits")
    )
    found = words.toArrow()
    bitmap = np.zeros(1 << (BITS - 5), np.uint32)
    bitmap[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).astype(np.uint32)
    return bitmap


def _hits(batches: Iterator[pa.RecordBatch], bitmap: Broadcast, short: list[int]) -> Iterator[pa.RecordBatch]:
    ids, bits = _PlainWords(), bitmap.value
    for batch in batches:
        for rows in slices(batch, 2):
            flat, bounds = word_ids([x.split() for x in rows.column(2).to_pylist()], ids)
            count = np.diff(bounds)
            owner = np.repeat(np.arange(len(count)), count)
            for span, _, hashes in _seed_hashes(flat, short):
                places = np.arange(len(hashes))
                for place in _bit_places(hashes, bits):
                    own = place[places]
                    places = places[(bits[own >> np.uint64(5)] >> (own & np.uint64(31)).astype(np.uint32)) & 1 == 1]
                places = places[owner[places] == owner[places + span - 1]]
                if not len(places):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0).take(pa.array(owner[places])),
                        rows.column(1).take(pa.array(owner[places])),
                        pa.array(hashes[places].view(np.int64)),
                        pa.array(places - bounds[owner[places]]),
                        pa.array([x.tobytes() for x in _around(flat, bounds, owner, places)], pa.binary()),
                    ],
                    names=["doc_id", "key", "hash", "word", "around"],
                )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits around which enough words are equal, with where those start and end."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, item = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, _AROUND) for k in (3, 6))
        size = np.asarray(batch.column(5)).astype(np.int64)
        equal = (doc == item) & (doc != 0)
        runs = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), axis=1)
        there = np.cumsum(np.pad(item != 0, ((0, 0), (1, 0))), axis=1)
        best = np.zeros(len(size), np.int64)
        start = np.full(len(size), -1)
        stop = np.full(len(size), -1)
        for length in np.unique(size):
            own = size == length
            need = length - SUBSTITUTIONS if length == OVERLAP else length
            match = runs[own][:, length:] - runs[own][:, :-length]
            match[there[own][:, length:] - there[own][:, :-length] < length] = 0  # not all of it is the item's
            good = match >= need
            best[own] = np.where(good, match, 0).max(axis=1)
            start[own] = np.where(good.any(axis=1), good.argmax(axis=1), -1)
            stop[own] = np.where(good.any(axis=1), good.shape[1] - 1 - good[:, ::-1].argmax(axis=1) + length, -1)
        kept = np.flatnonzero(best)
        word = np.asarray(batch.column(2)).astype(np.int64)[kept] - _BEFORE
        rows = pa.array(kept)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(rows),
                batch.column(1).take(rows),
                batch.column(4).take(rows),
                pa.array(word + start[kept]),
                pa.array(word + stop[kept] - 1),
                pa.array(best[kept].astype(np.int32)),
            ],
            names=["doc_id", "key", "item_id", "first_word", "last_word", "n_equal"],
        )
