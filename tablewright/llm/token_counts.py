"""Token counts of flat token files that have no index, by a scan for the separator.

A token file is the ids of documents one after another, each document followed by an
end-of-document id, as little-endian 16- or 32-bit numbers. Blocks of the files are
scanned apart from each other, each by one vectorised search; what a document has in the
blocks before the one it ends in is stitched by a prefix scan over the blocks' summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.places import Scratch, quoted
from tablewright.llm.stores import Draft, read_range
from tablewright.llm.texts import slices, utf8
from tablewright.llm.tokens import default_tokenizer, encoder

END_OF_DOCUMENT = 50_256
KIND = "<u2"
#: Bytes of a block, and of a file that the writer rolls.
BLOCK = 8 << 20
FILE = 64 << 20
#: Separators that one row lists; a block with more gives several rows.
LISTED = 1 << 16


def write_token_files(
    docs: DataFrame,
    folder: str,
    identity: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    end: int = END_OF_DOCUMENT,
    kind: str = KIND,
    roll: int = FILE,
) -> DataFrame:
    """Write the token files of ``docs`` and return ``file bytes number doc_id``, a row per document.

    ``number`` counts the documents of a file from 0; ``bytes`` is how long the file is
    when the document is in it. Null and empty texts are the separator alone. A text that
    spells the separator is ordinary text and does not end a document.
    """
    path = tokenizer or default_tokenizer()
    rows = docs.select(quoted(identity).alias("doc_id"), utf8(quoted(text)).alias("words"), F.spark_partition_id().alias("task"))
    out = T.StructType(
        [T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("number", T.LongType()), rows.schema["doc_id"]]
    )
    return rows.mapInArrow(lambda batches: _write(batches, folder, path, end, kind, roll), out)


def token_counts(files: DataFrame, folder: str, end: int = END_OF_DOCUMENT, kind: str = KIND, block: int = BLOCK) -> DataFrame:
    """``file number start n_tokens`` for each document in the token files ``files`` (``file``, ``bytes``).

    ``start`` is the place of a document's first token in its file; its separator is not
    among its tokens. Tokens after a file's last separator are a document without an end
    and are counted too. An empty file has no documents.
    """
    width = np.dtype(kind).itemsize
    block -= block % width
    sized = files.select("file", "bytes").where("bytes > 0")
    blocks = sized.select("file", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {block}L)")).alias("at"))
    dealt = blocks.repartition(sized.sparkSession.sparkContext.defaultParallelism, "file", "at")
    found = dealt.mapInArrow(
        lambda batches: _scan(batches, folder, end, kind, block), "file string, at long, left long, ends array<long>"
    )
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    after_last = F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1)
    # The prefix scan: where the document begins that is open at a block's start, and its number.
    stitched = found.withColumns(
        {
            "open": F.coalesce(F.max(after_last).over(before), F.lit(0)),
            "number": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        }
    )
    # What follows a file's last separator, in its last block, ends with the file.
    stop = F.when((F.col("left") >= 0) & (F.coalesce(after_last, F.col("open")) < F.col("left")), F.array("left"))
    ends = F.concat("ends", F.coalesce(stop, F.array().cast("array<long>")))
    starts = F.concat(F.array("open"), F.transform("ends", lambda x: x + 1))
    spans = stitched.select("file", "number", starts.alias("starts"), ends.alias("stops"))
    spans = spans.select("file", "number", F.slice("starts", F.lit(1), F.size("stops")).alias("starts"), "stops")
    # A row generated holds one start and one end, and no list.
    rows = spans.select("file", "number", F.posexplode(F.arrays_zip("starts", "stops")).alias("nth", "x"))
    return rows.select(
        "file",
        (F.col("number") + F.col("nth")).alias("number"),
        F.col("x.starts").alias("start"),
        (F.col("x.stops") - F.col("x.starts")).alias("n_tokens"),
    )


def count_document_tokens(docs: DataFrame, identity: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id n_tokens file number start`` per row of ``docs``, from token files written for it."""
    scratch = Scratch(docs.sparkSession)
    folder = scratch.folder("tokens")
    written = scratch.keep(write_token_files(docs, folder, identity, text, tokenizer), "documents")
    files = scratch.keep(written.groupBy("file").agg(F.max("bytes").alias("bytes")), "files")
    counts = token_counts(files, folder)
    # Both sides have a row per document: never broadcast, however small their files look.
    return written.join(counts.hint("merge"), ["file", "number"]).select("doc_id", "n_tokens", "file", "number", "start")


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, end: int, kind: str, roll: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path, kind, literal=True).encode
    last = np.array([end], kind).tobytes()
    draft, serial, number, name = None, 0, 0, ""
    for batch in batches:
        for rows in slices(batch, 1):
            found = encode(rows.column(1).to_pylist())
            out: tuple[list, list, list] = ([], [], [])
            for ids in found:
                if draft is not None and draft.size >= roll:
                    draft.commit()
                    draft = None
                if draft is None:
                    name = f"tokens-{rows.column(2)[0].as_py():06d}-{serial:04d}.bin"
                    draft, serial, number = Draft(folder, name), serial + 1, 0
                draft.write(ids + last)
                for column, value in zip(out, (name, draft.size, number), strict=True):
                    column.append(value)
                number += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), rows.column(0)],
                names=["file", "bytes", "number", "doc_id"],
            )
    if draft is not None:
        draft.commit()


def _scan(batches: Iterator[pa.RecordBatch], folder: str, end: int, kind: str, block: int) -> Iterator[pa.RecordBatch]:
    """The separators of each block, and the file's number of tokens (-1: not its last row)."""
    width = np.dtype(kind).itemsize
    for batch in batches:
        for name, size, at in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            data = np.frombuffer(read_range(folder, name, at, min(block, size - at)), kind)
            ends = np.flatnonzero(data == end) + at // width
            for first in range(0, max(1, len(ends)), LISTED):
                part = ends[first : first + LISTED]
                left = size // width if at + block >= size and first + LISTED >= len(ends) else -1
                # Fewer separators than bytes: the places of all rows of a file stay in order.
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([at + first], pa.int64()), pa.array([left], pa.int64()), pa.array([part], pa.list_(pa.int64()))],
                    names=["file", "at", "left", "ends"],
                )
