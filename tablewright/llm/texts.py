"""Arrow slices of texts for functions that compute with numpy, and ids of words."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.places import fresh_name, quoted

#: Bytes of text a function sees at once; a longer text comes alone.
SLICE_BYTES = 1 << 20
#: Words whose ids one Python worker remembers.
REMEMBERED = 1 << 18


def utf8(column: Column) -> Column:
    """The bytes of a text; a null text has none."""
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b""))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes in a column, one row at least."""
    if batch.num_rows == 0:
        return
    ends = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64))
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, last - first)
        first = last


def map_texts(
    frame: DataFrame, text: str, name: str, kind: T.StructType, compute: Callable[[list[bytes]], list[np.ndarray | pa.Array]]
) -> DataFrame:
    """The frame with a struct column ``name`` that ``compute`` makes of the texts' bytes."""
    passed, limit = len(frame.columns), SLICE_BYTES
    names = [*frame.columns, name]
    fields = kind.names
    # A column of strings is sent once and read as bytes; anything else becomes text first.
    plain = isinstance(frame.schema[text].dataType, T.StringType)
    column = frame.columns.index(text) if plain else passed
    sent = frame if plain else frame.withColumn(fresh_name(frame, "utf8"), utf8(quoted(text)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                texts = [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
                values = [pa.array(x) if isinstance(x, np.ndarray) else x for x in compute(texts)]
                struct = pa.StructArray.from_arrays(values, names=fields)
                yield pa.RecordBatch.from_arrays([*part.columns[:passed], struct], names=names)
        give_back()

    schema = T.StructType([*frame.schema.fields, T.StructField(name, kind)])
    return sent.mapInArrow(run, schema)


def give_back() -> None:
    """Return memory that Arrow keeps for later to the system: workers serve other tasks next."""
    pa.default_memory_pool().release_unused()


class WordIds(dict):
    """64-bit ids by word. Forgets all when full, so its memory is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_ids(words: list[list[bytes]], ids: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and where each text's words start and end."""
    bounds = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(x) for x in words], out=bounds[1:])
    flat = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.uint64, int(bounds[-1]))
    return flat, bounds


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (a multiply-xorshift finaliser)."""
    with np.errstate(over="ignore"):
        values = values ^ (values >> np.uint64(32))
        values = values * np.uint64(0xD6E8FEB86659FD93)
        values = values ^ (values >> np.uint64(32))
        values = values * np.uint64(0xD6E8FEB86659FD93)
        return values ^ (values >> np.uint64(32))


def rolled(ids: np.ndarray, size: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all windows of ``size`` consecutive ids: polynomials in ``factor``.

    Windows that run from one text into the next are there too; callers leave them out.
    """
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    count = len(ids) - size + 1
    total = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        done, part, width, shift = 0, ids, 1, np.uint64(factor)
        rest = size
        while rest:
            if rest & 1:
                # The windows so far are done ids long; the next width ids follow.
                total = total * shift + part[done : done + count]
                done += width
            rest >>= 1
            if rest:
                part = part[: len(part) - width] * shift + part[width:]
                shift = shift * shift
                width *= 2
    return mixed(total)
