"""Phrase collocations: words that stand together more often than their parts do apart.

n-grams are counted through an FM-index of each shard of the corpus, over word ids. A
shard is cut into pieces that no phrase crosses, each ended by a separator. The index has
two sides, one over the words and one over the words in reverse order; an n-gram is an
interval of rows of either side. Extending n-grams by a word on the left splits their
intervals by the words that precede their rows, and narrows those of the other side along
with them; extending on the right is the same with the sides exchanged. Both are done for
all n-grams of a length at once, and the sizes of the intervals are the counts. As no
n-gram is longer than ``longest``, rows need to be sorted by that many words only.

Counts of shards are summed by a shuffle, one length after the other. Only an n-gram whose
shorter parts are all frequent can be frequent: a bitmap of fixed size, in which frequent
ones have their bits, tells shards what to leave out. What it lets through in error is
only shuffled in vain, as it does not reach the least count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.places import Scratch, quoted
from tablewright.llm.texts import mixed, utf8

#: Words of a shard, which bounds a worker's memory; ids of words stay below it.
SHARD_WORDS = 1 << 20
#: Bytes of a text that are taken apart at once.
CHUNK_BYTES = 4 << 20
#: Bits of the bitmap of frequent n-grams, 16 MB on every worker; an n-gram has two of them.
BITS = 27
#: Rows of counts that a worker passes on at once.
_ROWS = 1 << 16
#: Scores are shares of a million, rounded down.
MILLION = 1_000_000

_SEPARATOR = b"\xff"  # in no UTF-8 text
_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def collocations(
    docs: DataFrame,
    text: str = "text",
    group: str = "lang",
    longest: int = 3,
    least: int = 10,
    share: int = 50,
    first: int = 2000,
) -> DataFrame:
    """The ``first`` phrases of each group by score: ``lang rank phrase a l r n score``.

    A-Z become lower case, a text ends a piece at each of ``.,;:!?`` and line breaks, and
    words are runs of characters other than space and tab. Phrases are two to ``longest``
    consecutive words of a piece that occur ``least`` times in their group. Cut after k
    words into parts that occur ``l`` and ``r`` times, a phrase that occurs ``a`` times
    scores a * a / (l * r) millionths, rounded down; its lowest cut counts, the smallest k
    of equal ones. Phrases go that lie inside a longer one with ``share`` per cent of their
    count. ``n`` is the number of words of the group. Equal scores go by ``a``, the larger
    first, then by phrase. A null group is ``und``, null and empty texts have no words, rows
    that repeat count each. Tables without a frequent phrase, and empty ones, give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.coalesce(quoted(group).cast("string"), F.lit("und")).alias("lang"), utf8(quoted(text)).alias("text"))
    words = scratch.keep(_counted(rows, 1, None), "words")
    totals = words.groupBy("lang").agg(F.sum("count").alias("n"))
    grams = [scratch.keep(words.where(F.col("count") >= least), "frequent")]
    for size in range(2, longest + 1):
        known = docs.sparkSession.sparkContext.broadcast(_bitmap(grams))
        grams.append(scratch.keep(_counted(rows, size, known).where(F.col("count") >= least), f"grams{size}"))
    phrases = [x.select("lang", "phrase", F.col("count").alias("a"), F.lit(size).alias("size")) for size, x in enumerate(grams[1:], 2)]
    scored = _scored(_union(phrases), _union(grams))
    kept = _without_parts(scored, _union(phrases), share)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _scored(phrases: DataFrame, grams: DataFrame) -> DataFrame:
    """``lang phrase a size l r score`` of the lowest cut."""
    words = F.split("phrase", " ", -1)
    cuts = phrases.select("lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "size", "k",
        F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("tail"),
    )
    for part, count in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(grams.select("lang", F.col("phrase").alias(part), F.col("count").alias(count)), ["lang", part])
    # Exact: counts below 10^15 give products below 10^36, which decimals hold.
    exact = {name: f"cast({name} AS decimal(15, 0))" for name in ("a", "l", "r")}
    score = F.expr(f"cast({MILLION} AS decimal(7, 0)) * ({exact['a']} * {exact['a']}) div ({exact['l']} * {exact['r']})")
    lowest = cuts.groupBy("lang", "phrase", "a", "size").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "phrase", "a", "size", "cut.l", "cut.r", "cut.score")


def _without_parts(scored: DataFrame, phrases: DataFrame, share: int) -> DataFrame:
    """Without phrases inside a longer one that has enough of their count."""
    words = F.split("phrase", " ", -1)
    inside = phrases.where(F.col("size") > 2).select("lang", "a", "size", words.alias("words"))
    inside = inside.select("lang", "a", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("length"))
    inside = inside.select(
        "lang", "a", "words", "length", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("length") + 1)).alias("from")
    )
    part = F.array_join(F.slice("words", F.col("from"), F.col("length")), " ")
    longer = inside.select("lang", part.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    joined = scored.join(longer, ["lang", "phrase"], "left")
    return joined.where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))


def _counted(rows: DataFrame, size: int, known: Broadcast | None) -> DataFrame:
    """``lang phrase count``: all n-grams of ``size`` words whose shorter parts are in ``known``."""
    parts = rows.mapInArrow(lambda batches: _count_shards(batches, size, known), "lang string, phrase binary, count long")
    counted = parts.groupBy("lang", "phrase").agg(F.sum("count").alias("count"))
    return counted.select("lang", F.col("phrase").cast("string").alias("phrase"), "count")


class Shard:
    """The word ids of a group's pieces, each piece ended by a separator, whose id is 0.

    A piece that a chunk or a shard cuts in two is continued: n-grams across the cut are
    counted apart, in ``seams``.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.ids: dict[bytes, int] = {_SEPARATOR: 0}
        self.parts: list[np.ndarray] = [np.zeros(1, np.int64)]
        self.length = 1
        self.seams: list[tuple[bytes, ...]] = []

    def add(self, words: list[bytes]) -> None:
        ids = self.ids
        for word in set(words).difference(ids):
            ids[word] = len(ids)
        self.parts += [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), np.zeros(1, np.int64)]
        self.length += len(words) + 1

    def seam(self, before: list[bytes], after: list[bytes]) -> None:
        """n-grams that start before a cut and end behind it."""
        joined = before + after
        for start in range(max(0, len(before) - self.size + 1), len(before)):
            gram = joined[start : start + self.size]
            if len(gram) == self.size and _SEPARATOR not in gram:
                self.seams.append(tuple(gram))

    def vocabulary(self) -> list[bytes]:
        return list(self.ids)


def _count_shards(batches: Iterator[pa.RecordBatch], size: int, known: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of a task's texts, a shard at a time."""
    shards: dict[str, Shard] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            key, last = lang.as_py(), []
            for words in _chunks(text.as_buffer()):
                shard = shards.setdefault(key, Shard(size))
                shard.seam(last, words[: size - 1])
                shard.add(words)
                last = (last + words[1 - size :])[1 - size :] if size > 1 else []
                held += len(words) + 1
                if held >= SHARD_WORDS:
                    yield from _shard_counts(shards, size, known)
                    shards, held = {}, 0
    yield from _shard_counts(shards, size, known)


def _chunks(text: pa.Buffer | None) -> Iterator[list[bytes]]:
    """The words of a text with separators, chunk by chunk; a chunk ends between words."""
    view = memoryview(text).cast("B") if text is not None else memoryview(b"")
    start = 0
    while start < len(view):
        end = min(start + CHUNK_BYTES, len(view))
        while end < len(view) and view[end] not in b" \t\n.,;:!?":
            end += 1
        plain = bytes(view[start:end]).lower().translate(_PLAIN)
        words = plain.replace(b"\n", b" \xff ").split()
        for first in range(0, len(words), SHARD_WORDS):
            yield words[first : first + SHARD_WORDS]
        start = end


def _shard_counts(shards: dict[str, Shard], size: int, known: Broadcast | None) -> Iterator[pa.RecordBatch]:
    for lang, shard in shards.items():
        words = shard.vocabulary()
        found = frequent_grams(np.concatenate(shard.parts), _word_hashes(words, lang), size, None if known is None else known.value)
        for first in range(0, len(found.count), _ROWS):
            columns = [map(words.__getitem__, column[first : first + _ROWS].tolist()) for column in found.words.T]
            phrases = list(map(b" ".join, zip(*columns, strict=True)))
            yield _rows(lang, phrases, found.count[first : first + _ROWS])
        for first in range(0, len(shard.seams), _ROWS):
            phrases = list(map(b" ".join, shard.seams[first : first + _ROWS]))
            yield _rows(lang, phrases, np.ones(len(phrases), np.int64))


def _rows(lang: str, phrases: list[bytes], count: np.ndarray) -> pa.RecordBatch:
    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(phrases), np.int32)), pa.array([lang])).dictionary_decode()
    return pa.RecordBatch.from_arrays([langs, pa.array(phrases, pa.binary()), pa.array(count)], names=["lang", "phrase", "count"])


@dataclass
class Grams:
    """n-grams of one length: their words' ids, their counts, and where their rows start in either side of the index."""

    words: np.ndarray
    count: np.ndarray
    starts: list[np.ndarray]

    def only(self, wanted: np.ndarray) -> Grams:
        return Grams(self.words[wanted], self.count[wanted], [x[wanted] for x in self.starts])


class Side:
    """An FM-index of a circular text of ids, for n-grams of at most ``depth`` ids."""

    def __init__(self, ids: np.ndarray, depth: int) -> None:
        order = _suffix_order(ids, depth)
        #: The id before each row, which is the Burrows-Wheeler transform, and the rows in its order.
        self.before = ids[order - 1]
        self.by_id = np.argsort(self.before, kind="stable")

    def rank(self) -> np.ndarray:
        """For each row, the row of the suffix that starts with the id before it."""
        rank = np.empty(len(self.by_id), np.int64)
        rank[self.by_id] = np.arange(len(self.by_id))
        return rank


class PhraseIndex:
    """Both sides of an index over ids, for n-grams of at most ``depth`` ids that grow on the left first, then in turn."""

    def __init__(self, ids: np.ndarray, depth: int) -> None:
        self.symbols = int(ids.max()) + 1
        self.count = np.bincount(ids, minlength=self.symbols)
        self.starts = np.cumsum(self.count) - self.count
        # Left words make even lengths and right ones odd lengths; a side has to tell no more ids apart.
        left, right = depth - depth % 2, depth - (depth + 1) % 2
        self.sides = [Side(ids, left), Side(ids[::-1], right) if right > 1 else None]

    def single(self) -> Grams:
        """Every id but the separator."""
        ids = np.arange(1, self.symbols)
        return Grams(ids[:, None], self.count[1:], [self.starts[1:], self.starts[1:]])

    def _rows(self, grams: Grams, here: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of all n-grams, whose they are, and where each one's begin among them."""
        owner = np.repeat(np.arange(len(grams.count)), grams.count)
        begin = np.cumsum(grams.count) - grams.count
        return np.arange(len(owner)) - begin[owner] + grams.starts[here][owner], owner, begin

    def extended(self, grams: Grams, right: bool) -> Grams:
        """All n-grams that are one of ``grams`` and one id more on its left or right."""
        here, there = (1, 0) if right else (0, 1)
        side = self.sides[here]
        rows, owner, begin = self._rows(grams, here)
        added = side.before[rows]
        order = np.argsort(owner * self.symbols + added, kind="stable")
        owner, added, rows = owner[order], added[order], rows[order]
        first, count = _groups(owner, added)
        parent = owner[first]
        starts = [np.zeros(0, np.int64)] * 2
        starts[here] = side.rank()[rows[first]]
        # On the other side the n-gram's rows go by the id that was added: what is smaller comes before.
        starts[there] = grams.starts[there][parent] + first - begin[parent]
        return Grams(_joined(grams.words[parent], added[first], right), count, starts)

    def last_extended(self, grams: Grams, right: bool) -> Grams:
        """The same without the places of the rows, which nothing follows that needs them.

        The rows are in the order of the ids before them already, and n-grams in theirs.
        """
        here = 1 if right else 0
        side = self.sides[here]
        rows, owners, _ = self._rows(grams, here)
        of_row = np.full(len(side.before), -1, np.int32)
        of_row[rows] = owners
        owner = of_row[side.by_id]
        chosen = np.flatnonzero(owner >= 0)
        owner, added = owner[chosen], side.before[side.by_id[chosen]]
        first, count = _groups(owner, added)
        return Grams(_joined(grams.words[owner[first]], added[first], right), count, [])


def _groups(owner: np.ndarray, added: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal pairs start and how long they are, without those of the separator."""
    edge = np.ones(len(owner), bool)
    edge[1:] = (owner[1:] != owner[:-1]) | (added[1:] != added[:-1])
    first = np.flatnonzero(edge)
    count = np.diff(np.append(first, len(owner)))
    real = added[first] != 0
    return first[real], count[real]


def _joined(words: np.ndarray, added: np.ndarray, right: bool) -> np.ndarray:
    return np.hstack([words, added[:, None]] if right else [added[:, None], words])


def frequent_grams(ids: np.ndarray, hashes: np.ndarray, size: int, known: np.ndarray | None) -> Grams:
    """The n-grams of ``size`` ids all of whose shorter parts have their bits in ``known``, with their counts."""
    if size == 1:
        count = np.bincount(ids, minlength=len(hashes))[1:]
        return Grams(np.arange(1, len(hashes))[:, None], count, []).only(count > 0)
    index = PhraseIndex(ids, size)
    grams = index.single()
    grams = grams.only(_has_bits(known, _gram_hashes(hashes, grams.words)) & (grams.count > 0))
    for length in range(2, size + 1):
        right = length % 2 == 1
        grams = (index.extended if length < size else index.last_extended)(grams, right)
        # One of the two parts is known, as it was extended; so is the other's first or last word, but not the other.
        other = grams.words[:, 1:] if right else grams.words[:, :-1]
        grams = grams.only(_has_bits(known, _gram_hashes(hashes, other)))
        if length < size:
            grams = grams.only(_has_bits(known, _gram_hashes(hashes, grams.words)))
    return grams


def _suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """Rows of a circular text sorted by their first ``depth`` ids."""
    key, width = ids, 1
    while width < depth:
        if width > 1:
            key = np.unique(key, return_inverse=True)[1]
        step = min(width, depth - width)
        key = key * (int(key.max()) + 1) + np.roll(key, -step)
        width += step
    return np.argsort(key, kind="stable")


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.fromiter((xxhash.xxh3_64_intdigest(word, seed) for word in words), np.uint64, len(words))


def _gram_hashes(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    total = np.full(len(words), words.shape[1], np.uint64)
    with np.errstate(over="ignore"):
        for column in words.T:
            total = total * _FACTOR + hashes[column]
    return mixed(total)


def _has_bits(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    found = np.ones(len(hashes), bool)
    for place in _bits_of(hashes):
        found &= (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


def _bits_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = np.uint64((1 << BITS) - 1)
    return hashes & most, (hashes >> np.uint64(BITS)) & most


def _phrase_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_size: dict[int, list[np.ndarray]] = {}
        for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = phrase.split(b" ")
            by_size.setdefault(len(words), []).append(_word_hashes(words, lang))
        for rows in by_size.values():
            flat = np.concatenate(rows)
            hashes = _gram_hashes(flat, np.arange(len(flat)).reshape(len(rows), -1))
            places = np.unique(np.concatenate(_bits_of(hashes)))
            yield pa.RecordBatch.from_arrays([pa.array(places.view(np.int64))], names=["bit"])


def _bitmap(grams: list[DataFrame]) -> np.ndarray:
    """The bits of all frequent n-grams so far; at most 2^27 bits come to the driver."""
    known = _union(grams).select("lang", F.col("phrase").cast("binary").alias("phrase"))
    bits = known.mapInArrow(_phrase_bits, "bit long")
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(_one_bit(F.col("bit"))).alias("bits"))
    found = words.toArrow()
    bitmap = np.zeros(1 << (BITS - 6), np.uint64)
    bitmap[np.asarray(found.column("word"))] = np.asarray(found.column("bits")).astype(np.int64).view(np.uint64)
    return bitmap


def _one_bit(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
