"""Best-fit packing of tokenised documents into sequences of bounded length.

Pieces are dealt over packing tasks by hash, so many to a task however large the input is,
and go through an online best-fit with a fixed number of open bins: a bitset has a bit for
each amount of free space that some open bin has, so the bin with the least sufficient
space is found by a shift. When no more bins may be open, the fullest closes. Within a
task the longest pieces come first, which leaves least space unused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.places import quoted
from tablewright.llm.texts import slices, utf8
from tablewright.llm.tokens import default_tokenizer, encoder

SEQUENCE = 1024
END = 2
#: Documents whose pieces one task packs, and bins it may have open.
DOCUMENTS = 1 << 15
OPEN_BINS = 1 << 15
_ID_BYTES = 4


def pack_documents(
    docs: DataFrame,
    identity: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end: int = END,
    size: int = SEQUENCE,
) -> DataFrame:
    """One row per piece: ``doc_id piece start length ids sequence_id offset``.

    A document is its token ids and ``end``; null and empty texts are ``end`` alone. Only
    one longer than ``size`` is cut, into pieces of ``size``, of which the first takes
    what is over. ``ids`` are little-endian unsigned 32-bit numbers, ``start`` counts the
    document's ids before the piece, ``offset`` the sequence's. Each row of ``docs`` is a
    document, also where rows or identities repeat or an identity is null.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(quoted(identity).alias("doc_id"), utf8(quoted(text)).alias("words"))
    kind = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )
    pieces = rows.mapInArrow(lambda batches: _pieces(batches, path, end, size), kind)
    tasks = max(1, -(-docs.count() // DOCUMENTS))
    dealt = pieces.repartition(tasks, F.xxhash64("doc_id", "piece", "ids"))
    ordered = dealt.sortWithinPartitions(F.desc("length"), "doc_id", "piece", "ids").withColumn("task", F.spark_partition_id())
    placed = T.StructType([*kind.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ordered.mapInArrow(lambda batches: _place(batches, size, OPEN_BINS), placed)


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).encode
    last = np.array([end], "<u4").tobytes()
    for batch in batches:
        for rows in slices(batch, 1):
            row, piece, start, length, ids = [], [], [], [], []
            for k, found in enumerate(encode(rows.column(1).to_pylist())):
                found += last
                count = len(found) // _ID_BYTES
                bounds = [0, *range((count - 1) % size + 1, count + 1, size)]
                for n, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    row.append(k)
                    piece.append(n)
                    start.append(x)
                    length.append(y - x)
                    ids.append(found[x * _ID_BYTES : y * _ID_BYTES])
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(ids, pa.binary()),
                ],
                names=["doc_id", "piece", "start", "length", "ids"],
            )


class OpenBins:
    """Bins that still take pieces, by free space."""

    def __init__(self, size: int, most: int) -> None:
        self.size, self.most = size, most
        self.bins = 0
        self._open = 0
        self._bits = 0  # bit n: some open bin has n free
        self._with: list[list[int]] = [[] for _ in range(size + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The bin a piece of that length goes to, and how much lies in it already."""
        fitting = self._bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.bins, self.size
            self.bins += 1
            if self._open >= self.most:
                self._take((self._bits & -self._bits).bit_length() - 1)  # the fullest closes
        if free > length:
            self._with[free - length].append(number)
            self._bits |= 1 << (free - length)
            self._open += 1
        return number, self.size - free

    def _take(self, free: int) -> int:
        number = self._with[free].pop()
        if not self._with[free]:
            self._bits ^= 1 << free
        self._open -= 1
        return number


def _place(batches: Iterator[pa.RecordBatch], size: int, most: int) -> Iterator[pa.RecordBatch]:
    bins = OpenBins(size, most)
    for batch in batches:
        base = (batch.column(5)[0].as_py() << 32) if batch.num_rows else 0
        places = [bins.place(n) for n in batch.column(3).to_pylist()]
        sequence = pa.array([base + number for number, _ in places], pa.int64())
        offset = pa.array([used for _, used in places], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], sequence, offset], names=[*batch.schema.names[:5], "sequence_id", "offset"]
        )
