"""Exact repeats of many words across documents, found by fixed-block anchors.

A window of 50 words holds at least one of its document's non-overlapping 25-word blocks
(25 = (50 + 1) // 2). So two documents that share a window also share a block of one of
them, which a rolling 25-word window of the other hits.

1. Every document's rolling windows probe the blocks of all others. Hashes meet in
   buckets: a slice of documents sends each hash it has once, four bytes long, with its
   place and whether it is a block. What occurs twice in a slice is a hit already, so a
   passage that a third of all documents share sends one entry a slice.
2. Hits are extended: each 50-word window around a hit, by a 96-bit hash, looks for the
   smallest identity among the documents it starts in; overlapping windows form the
   maximal repeats. Again a slice sends each window once, for its smallest identity.
3. The words of the repeats go from all documents but those with the smallest identity.

What meets by hash in step 1 is only a candidate, so its short hashes lose nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.places import Scratch, fresh_name, quoted
from tablewright.llm.texts import SLICE_BYTES, WordIds, mixed, rolled, slices, utf8, word_ids

WINDOW = 50
#: Text whose windows one bucket should hold, in bytes; the number of buckets follows the input.
BUCKET_BYTES = 16 << 20
#: Text of one slice, in bytes; larger slices send fewer entries and take more memory.
_SLICE = SLICE_BYTES
#: A missing identity counts as larger than any.
_NO_ID = np.iinfo(np.int64).max
_SECOND = 0xC2B2AE3D27D4EB4F
_RANGES = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))


def repeated_spans(docs: DataFrame, identity: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``id``, ``key``, ``spans``: the word ranges that documents with smaller identities have too.

    One row per document with such words, repeated rows having one together; ``key`` is
    ``row_key`` of the row. Each range has its first word and the word after its last,
    counted from 0. Rows with equal identities do not take words from each other; a null
    identity counts as the largest.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(
        quoted(identity).cast("long").alias("id"), row_key(identity, text).alias("key"), utf8(quoted(text)).alias("words")
    )
    size = rows.agg(F.sum(F.length("words"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))
    # Repeated rows each have their own finds; more than one of them would multiply the rows of the joins.
    hits = scratch.keep(_exchange(rows, _Anchors(window), buckets).dropDuplicates(["id", "key"]), "hits")
    scratch.release()
    # Ranges grow with the documents: they are not broadcast, however few a sample has.
    near = hits.withColumnsRenamed({"id": "hit_id", "key": "hit_key"}).hint("merge")
    windows = rows.join(near, _same("id", "key", "hit_id", "hit_key")).select("id", "key", "words", "spans")
    found = scratch.keep(_exchange(windows, _Windows(window), buckets).dropDuplicates(["id", "key"]), "spans")
    scratch.drop(hits)
    del near, windows, hits
    scratch.release()
    return found


def row_key(identity: str, text: str) -> Column:
    """Tells rows apart that share an identity."""
    return F.xxhash64(quoted(identity), utf8(quoted(text)))


def with_spans(docs: DataFrame, name: str, identity: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with a column of the word ranges that are repeats; null where there are none."""
    found = repeated_spans(docs, identity, text, window)
    key = fresh_name(docs, "row_key")
    found = found.select(F.col("id").alias(f"{key}_id"), F.col("key").alias(f"{key}_of"), F.col("spans").alias(name))
    keyed = docs.withColumn(key, row_key(identity, text)).withColumn(f"{key}_long", quoted(identity).cast("long"))
    joined = keyed.join(found.hint("merge"), _same(f"{key}_long", key, f"{key}_id", f"{key}_of"), "left")
    return joined.select(*map(quoted, docs.columns), quoted(name))


def removed_words(docs: DataFrame, identity: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (bytes: the kept words, a space between) per row.

    Words are runs of bytes other than space and \\t to \\r; null and empty texts have none.
    """
    rows = docs.select(quoted(identity).alias("doc_id"), quoted(text).alias("text"))
    marked = with_spans(rows, "spans", "doc_id", "text", window)
    kind = T.StructType(
        [rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())]
    )
    return marked.select("doc_id", utf8(F.col("text")).alias("text"), "spans").mapInArrow(_cut_words, kind)


def drop_repeats(docs: DataFrame, identity: str = "doc_id", text: str = "text", size: str = "n_chars") -> DataFrame:
    """``docs`` without the repeated words; the other words keep the white space before them.

    Texts without repeats stay as they are, nulls too. A column ``size`` of ``docs`` gets
    the new number of characters where the text has changed. No row goes.
    """
    name = fresh_name(docs, "spans")
    marked = with_spans(docs, name, identity, text)
    shortened = fresh_name(marked, "shortened")
    kind = T.StructType([*docs.schema.fields, T.StructField(shortened, T.BinaryType())])
    width, names = len(docs.columns), kind.names
    sent = marked.withColumn(shortened, F.when(quoted(name).isNotNull(), utf8(quoted(text))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            new = [_cut(x, s) if s else None for x, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(new, pa.binary())], names=names)

    cut = sent.mapInArrow(run, kind)
    new = quoted(shortened).cast("string")
    changed = {text: F.when(quoted(shortened).isNotNull(), new).otherwise(quoted(text))}
    if size in docs.columns:
        kept = docs.schema[size].dataType
        changed[size] = F.when(quoted(shortened).isNotNull(), F.length(new).cast(kept)).otherwise(quoted(size))
    return cut.withColumns(changed).drop(shortened)


def _same(id_a: str, key_a: str, id_b: str, key_b: str) -> Column:
    """The key is a function of the identity, so its equality is what is joined on."""
    return (quoted(key_a) == quoted(key_b)) & quoted(id_a).eqNullSafe(quoted(id_b))


# --- hashes that meet across slices -----------------------------------------------


@dataclass
class _Slice:
    """Documents that are looked at together: identities, keys, word hashes and bounds."""

    identity: np.ndarray
    known: np.ndarray
    key: np.ndarray
    flat: np.ndarray
    bounds: np.ndarray
    spans: list | None

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.key)), np.diff(self.bounds))

    def starts(self, size: int) -> np.ndarray:
        """Where windows of that many words start that lie in one document."""
        left = np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(len(self.flat))
        return np.flatnonzero(left >= size)


class _Anchors:
    """Step 1: rolling windows meet blocks."""

    hash_bytes, with_identity = 4, False

    def __init__(self, window: int) -> None:
        self.size = (window + 1) // 2
        self.window = window

    def entries(self, part: _Slice) -> tuple[np.ndarray, ...]:
        """Hash bytes, bucket hashes and places to send; places found already."""
        places = part.starts(self.size)
        long = np.diff(part.bounds)[part.owner[places]] >= self.window
        places = places[long]
        hashes = rolled(part.flat, self.size)[places] if len(places) else np.zeros(0, np.uint64)
        block = (places - part.bounds[part.owner[places]]) % self.size == 0
        order = np.lexsort((~block, hashes))
        ordered = hashes[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
        twice = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1 if len(new) else new
        sent = np.sort(order[new])  # of each hash one, a block if it has one
        low = (hashes[sent] & ~np.uint64(1)) | block[sent]
        return low.view(np.uint8).reshape(-1, 8)[:, :4], hashes[sent] >> np.uint64(40), places[sent], places[order[twice]]

    def meet(self, digits: np.ndarray, identity: np.ndarray | None) -> np.ndarray:
        """Which entries of a bucket share their hash with another, one of them being a block."""
        values = np.ascontiguousarray(digits).view(np.uint32)[:, 0]
        block, values = values & np.uint32(1), values >> np.uint32(1)
        order = np.argsort(values)
        ordered = values[order]
        group = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        hit = (np.bincount(group) > 1) & (np.bincount(group, block[order]) > 0)
        found = np.zeros(len(values), bool)
        found[order] = hit[group]
        return found

    def ranges(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of all windows around a hit."""
        return places + self.size - self.window, places + self.window


class _Windows:
    """Step 2: windows around hits meet the smallest identity that has them."""

    hash_bytes, with_identity = 12, True

    def __init__(self, window: int) -> None:
        self.size = self.window = window

    def entries(self, part: _Slice) -> tuple[np.ndarray, ...]:
        places = part.starts(self.size)
        near = np.zeros(len(part.flat) + 1, np.int32)
        for at, spans in zip(part.bounds, part.spans, strict=False):
            for span in spans:
                near[at + span["first"]] += 1
                near[at + max(span["first"], span["last"] - self.size + 1)] -= 1
        places = places[np.cumsum(near[:-1])[places] > 0]
        if not len(places):
            return np.zeros((0, 12), np.uint8), np.zeros(0, np.uint64), places, places
        first = rolled(part.flat, self.size)[places]
        second = rolled(part.flat, self.size, _SECOND)[places].astype(np.uint32)
        identity = part.identity[part.owner[places]]
        order = np.lexsort((identity, second, first))
        a, b, who = first[order], second[order], identity[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        least = who[new][np.cumsum(new) - 1]
        sent = np.sort(order[who == least])  # the smallest identity's, as often as it has them
        digits = np.hstack([x[sent].view(np.uint8).reshape(len(sent), -1) for x in (first, second)])
        return digits, first[sent] >> np.uint64(40), places[sent], places[order[who > least]]

    def meet(self, digits: np.ndarray, identity: np.ndarray | None) -> np.ndarray:
        first = np.ascontiguousarray(digits[:, :8]).view(np.uint64)[:, 0]
        second = np.ascontiguousarray(digits[:, 8:]).view(np.uint32)[:, 0]
        order = np.lexsort((identity, second, first))
        a, b, who = first[order], second[order], identity[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        found = np.zeros(len(digits), bool)
        found[order] = who > who[new][np.cumsum(new) - 1]
        return found

    def ranges(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return places, places + self.window


_SENT = "bucket int, slice long, n int, digits binary, places binary, ids binary"
_FOUND = "slice long, n int, places binary, ids binary"


def _exchange(rows: DataFrame, step: _Anchors | _Windows, buckets: int) -> DataFrame:
    """``id``, ``key``, ``spans`` of the documents in which ``step`` finds something."""
    emitted = rows.mapInArrow(lambda batches: _emit(batches, step, buckets, _SLICE), _SENT)
    met = emitted.groupBy("bucket").applyInArrow(_meet(step), _FOUND)
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("spans", _RANGES)])
    return met.groupBy("slice").applyInArrow(_gather(step), kind)


def _emit(batches: Iterator[pa.RecordBatch], step: _Anchors | _Windows, buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    """A slice's entries by bucket, what it has found itself, and its list of documents.

    The list and the finds, whose ``digits`` are null, pass through some bucket.
    """
    ids = WordIds()
    for batch in batches:
        for rows in slices(batch, 2, limit):
            part = _slice(rows, ids)
            name = xxhash.xxh3_64_intdigest(part.key.tobytes() + part.identity.tobytes()) >> 1
            digits, spread, places, found = step.entries(part)
            bucket = (mixed(spread) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            ends = np.cumsum(np.bincount(bucket, minlength=buckets)) if len(bucket) else np.zeros(buckets, np.int64)
            identity = part.identity[part.owner[places]] if step.with_identity else None
            out = []
            for b in range(buckets):
                of = order[(int(ends[b - 1]) if b else 0) : int(ends[b])]
                if len(of):
                    who = _planes(identity[of]) if identity is not None else None
                    out.append((b, name, len(of), _planes(digits[of]), _planes(places[of].astype(np.uint32)), who))
            if len(found):
                out.append((name % buckets, name, len(found), None, _planes(np.sort(found).astype(np.uint32)), None))
            if out:
                listed = np.stack([part.bounds[:-1], part.identity, part.known, part.key])
                out.append((name % buckets, name, -len(part.key), None, _planes(np.append(listed.ravel(), part.bounds[-1])), None))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(columns[0], pa.int32()),
                        pa.array(columns[1], pa.int64()),
                        pa.array(columns[2], pa.int32()),
                        *(pa.array(x, pa.binary()) for x in columns[3:]),
                    ],
                    names=["bucket", "slice", "n", "digits", "places", "ids"],
                )


def _slice(rows: pa.RecordBatch, ids: WordIds) -> _Slice:
    known = np.asarray(rows.column(0).is_valid())
    identity = np.asarray(rows.column(0).fill_null(_NO_ID)).astype(np.int64)
    key = np.asarray(rows.column(1)).astype(np.int64)
    flat, bounds = word_ids([x.split() for x in rows.column(2).to_pylist()], ids)
    return _Slice(identity, known, key, flat, bounds, rows.column(3).to_pylist() if rows.num_columns > 3 else None)


def _meet(step: _Anchors | _Windows) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        sent = table.filter(table.column("digits").is_valid())
        passed = table.filter(table.column("digits").is_null()).select(["slice", "n", "places", "ids"])
        if not sent.num_rows:
            return passed
        counts = sent.column("n").to_pylist()
        digits = np.concatenate([_whole(x, n, np.uint8, step.hash_bytes) for x, n in zip(sent.column("digits").to_pylist(), counts, strict=True)])
        identity = None
        if step.with_identity:
            identity = np.concatenate([_whole(x, n, np.int64)[:, 0] for x, n in zip(sent.column("ids").to_pylist(), counts, strict=True)])
        found = step.meet(digits, identity)
        out = {"slice": [], "n": [], "places": []}
        for name, places, n, hit in zip(
            sent.column("slice").to_pylist(), sent.column("places").to_pylist(), counts, np.split(found, np.cumsum(counts)[:-1]), strict=True
        ):
            if hit.any():
                out["slice"].append(name)
                out["n"].append(int(hit.sum()))
                out["places"].append(_planes(_whole(places, n, np.uint32)[:, 0][hit]))
        made = pa.table(
            [pa.array(out["slice"], pa.int64()), pa.array(out["n"], pa.int32()), pa.array(out["places"], pa.binary()), pa.nulls(len(out["n"]), pa.binary())],
            names=["slice", "n", "places", "ids"],
        )
        return pa.concat_tables([passed, made])

    return run


def _gather(step: _Anchors | _Windows) -> Callable[[pa.Table], pa.Table]:
    """The finds of a slice, as ranges of words of its documents."""

    def run(table: pa.Table) -> pa.Table:
        counts, blobs = table.column("n").to_pylist(), table.column("places").to_pylist()
        places = [_whole(x, n, np.uint32)[:, 0].astype(np.int64) for x, n in zip(blobs, counts, strict=True) if n >= 0]
        size, listed = next((-n, x) for x, n in zip(blobs, counts, strict=True) if n < 0)
        listed = _whole(listed, 4 * size + 1, np.int64)[:, 0]
        bounds = np.append(listed[:size], listed[-1])
        identity, known, key = listed[size:-1].reshape(3, size)
        out: list[tuple] = []
        if places:
            at = np.unique(np.concatenate(places))
            owner = np.searchsorted(bounds, at, side="right") - 1
            first, last = step.ranges(at)
            first, last = np.maximum(first, bounds[owner]), np.minimum(last, bounds[owner + 1])
            # Ranges that touch or overlap in one document become one.
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (first[1:] > np.maximum.accumulate(last)[:-1])))
            first, last, owner = first[new], np.maximum.reduceat(last, np.flatnonzero(new)), owner[new]
            for doc in np.unique(owner):
                own = owner == doc if len(owner) < 64 else slice(*np.searchsorted(owner, (doc, doc + 1)))
                spans = [{"first": int(x), "last": int(y)} for x, y in zip(first[own] - bounds[doc], last[own] - bounds[doc], strict=True)]
                out.append((int(identity[doc]) if known[doc] else None, int(key[doc]), spans))
        who, keys, spans = zip(*out, strict=True) if out else ((), (), ())
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return pa.table([pa.array(who, pa.int64()), pa.array(keys, pa.int64()), pa.array(spans, kind)], names=["id", "key", "spans"])

    return run


def _planes(values: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: like bytes side by side compress."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def _whole(planes: bytes, count: int, kind: type, width: int = 1) -> np.ndarray:
    data = np.frombuffer(planes, np.uint8).reshape(-1, count).T
    return np.ascontiguousarray(data).view(kind).reshape(count, width)


# --- cutting ----------------------------------------------------------------------


def _cut_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, removed, kept = [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = text.split()
            count.append(len(words))
            removed.append(sum(span["last"] - span["first"] for span in spans or ()))
            for span in reversed(spans or ()):
                del words[span["first"] : span["last"]]
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )


_SPACES = bytes([32, *range(9, 14)])


def _cut(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of the spans and the white space before them."""
    data = np.frombuffer(text, np.uint8)
    inside = ~np.isin(data, np.frombuffer(_SPACES, np.uint8))
    ends = np.flatnonzero(inside & ~np.append(inside[1:], False)) + 1  # after each word
    pieces, at = [], 0
    for span in spans:
        pieces.append(text[at : int(ends[span["first"] - 1]) if span["first"] else 0])
        at = int(ends[span["last"] - 1])
    return b"".join([*pieces, text[at:]])

