"""WARC archives, written in shards that come out the same however often a task runs.

Records are range-sorted by identity, so a shard is a range of them; within a shard files
roll once their compressed size reaches a limit. Headers and digests are made anew from
the payload. A file is written under a temporary name and renamed when complete; what
counts is the manifest of all files, which is a table written after them.

Of records with equal payloads one is a response, the others are revisits without the
payload that refer to it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.places import Scratch, quoted
from tablewright.llm.stores import Draft, open_file
from tablewright.llm.texts import utf8

#: Compressed bytes after which a file rolls, and records a shard should have.
ROLL = 64 << 20
SHARD = 1 << 14
#: Rows up to which the list of repeated payloads is broadcast: 64 MB at most.
FEW = 1 << 19
# The profile of a revisit with an equal payload, and the namespace of record ids.
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_DATE = datetime(2000, 1, 1, tzinfo=UTC)


def write_warc(
    pages: DataFrame,
    folder: str,
    identity: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = 0,
    roll: int = ROLL,
    date: datetime = _DATE,
) -> DataFrame:
    """Write an archive record per row of ``pages`` and return the manifest: ``file records bytes sha256``.

    A null payload is empty, a null URL too. Of payloads of at least ``least`` bytes that
    are equal, the row with the largest identity is the response; rows that repeat that
    identity are responses too. Rows without identity refer to it like others, and where
    no row of an equal payload has one, all are responses. An empty table has no files.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    rows = pages.select(
        quoted(identity).alias("id"), F.coalesce(quoted(url).cast("string"), F.lit("")).alias("url"), utf8(quoted(payload)).alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    repeated = (
        rows.where(F.length("payload") >= least)
        .groupBy(F.col("digest").alias("of"))
        .agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND refers_to IS NOT NULL")
        .select("of", "refers_to")
    )
    repeated = scratch.keep(repeated, "repeated")
    if repeated.count() <= FEW:
        repeated = F.broadcast(repeated)
    same = (F.col("digest") == F.col("of")) & (F.length("payload") >= least)
    known = rows.join(repeated, same, "left").drop("of")
    revisit = F.col("refers_to").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers_to"))
    known = known.withColumn("refers_to", F.when(revisit, F.col("refers_to")))
    shards = max(1, -(-pages.count() // SHARD))
    ordered = known.repartitionByRange(shards, "id", "digest", "url").sortWithinPartitions("id", "digest", "url")
    sent = ordered.withColumn("shard", F.spark_partition_id())
    manifest = sent.mapInArrow(lambda batches: _write(batches, folder, roll, date), "file string, records long, bytes long, sha256 string")
    return scratch.keep(manifest, "manifest")


def read_warc(manifest: DataFrame, folder: str, identity: T.DataType | None = None) -> DataFrame:
    """The records of a manifest's files: ``page_id url payload payload_bytes payload_digest record_type refers_to``.

    A revisit's ``payload`` is null; its length and digest are those of the full payload,
    taken from the record's headers. A response's are computed from the payload read.
    """
    kind = T.StructType(
        [
            T.StructField("page_id", T.StringType()),
            T.StructField("url", T.StringType()),
            T.StructField("payload", T.BinaryType()),
            T.StructField("payload_bytes", T.LongType()),
            T.StructField("payload_digest", T.StringType()),
            T.StructField("record_type", T.StringType()),
            T.StructField("refers_to", T.StringType()),
        ]
    )
    tasks = manifest.sparkSession.sparkContext.defaultParallelism
    files = manifest.select("file").repartition(tasks, "file")
    found = files.mapInArrow(lambda batches: _read(batches, folder), kind)
    to = identity or T.LongType()
    return found.withColumns({name: F.col(name).cast(to) for name in ("page_id", "refers_to")})


def archive_pages(pages: DataFrame, identity: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back."""
    folder = Scratch(pages.sparkSession).folder("warc")
    manifest = write_warc(pages, folder, identity, url, payload, least)
    return read_warc(manifest, folder, pages.schema[identity].dataType)


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- writing ----------------------------------------------------------------------


def _member(data: bytes) -> bytes:
    """A gzip member that depends on nothing but the data."""
    return gzip.compress(data, 6, mtime=0)


def _header(lines: list[tuple[str, str]], first: str) -> bytes:
    return "".join([first, "\r\n", *(f"{name}: {value}\r\n" for name, value in lines), "\r\n"]).encode()


def _clean(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def _record(identity: object, url: str, data: bytes, digest: bytes, refers_to: object, date: str, nth: int) -> bytes:
    key = f"{identity}/{url}/{digest.hex()}/{nth}"
    bare = base64.b32encode(digest).decode()
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(data)))], "HTTP/1.1 200 OK")
    block = http if refers_to is not None else http + data
    lines = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, key)}>"),
        ("WARC-Target-URI", _clean(url)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{bare}"),
        ("WARC-Block-Digest", f"sha1:{payload_digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        *([("X-Page-ID", str(identity))] if identity is not None else []),
        *([("WARC-Profile", _PROFILE), ("X-Refers-To-Page-ID", str(refers_to))] if refers_to is not None else []),
    ]
    return _member(_header(lines, "WARC/1.1") + block + b"\r\n\r\n")


def _write(batches: Iterator[pa.RecordBatch], folder: str, roll: int, date: datetime) -> Iterator[pa.RecordBatch]:
    """One row per file written."""
    stamp = date.strftime("%Y-%m-%dT%H:%M:%SZ")
    info = _member(
        _header(
            [
                ("WARC-Type", "warcinfo"),
                ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMESPACE, 'warcinfo')}>"),
                ("WARC-Date", stamp),
                ("Content-Type", "application/warc-fields"),
                ("Content-Length", "18"),
            ],
            "WARC/1.1",
        )
        + b"format: WARC/1.1\r\n\r\n\r\n"
    )
    draft, serial, records, sums, name = None, 0, 0, hashlib.sha256(), ""
    last, nth = None, 0

    def put(data: bytes) -> None:
        draft.write(data)
        sums.update(data)

    def close() -> pa.RecordBatch:
        draft.commit()
        return pa.RecordBatch.from_pylist(
            [{"file": name, "records": records, "bytes": draft.size, "sha256": sums.hexdigest()}],
            pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]),
        )

    for batch in batches:
        for k in range(batch.num_rows):
            identity, url, data, digest, refers_to, shard = (batch.column(c)[k].as_py() for c in range(6))
            # Rows that repeat all of these are told apart by a number.
            nth = nth + 1 if (identity, url, digest) == last else 0
            last = (identity, url, digest)
            if draft is not None and draft.size >= roll:
                yield close()
                draft = None
            if draft is None:
                name = f"pages-{shard:06d}-{serial:04d}.warc.gz"
                draft, serial, records, sums = Draft(folder, name), serial + 1, 0, hashlib.sha256()
                put(info)
            put(_record(identity, url, data, digest, refers_to, stamp, nth))
            records += 1
    if draft is not None:
        yield close()


# --- reading ----------------------------------------------------------------------


def _headers(stream: BinaryIO) -> tuple[str, dict[str, str]]:
    first = stream.readline().decode().rstrip("\r\n")
    found = {}
    while (line := stream.readline().decode().rstrip("\r\n")):
        name, _, value = line.partition(":")
        found[name.strip().lower()] = value.strip()
    return first, found


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed archive."""
    while True:
        version, headers = _headers(stream)
        if not version:
            return
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record where one should start: {version[:40]!r}")
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is not whole")
        yield headers, block


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        for file in batch.column(0).to_pylist():
            out, held = [], 0
            with open_file(folder, file) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for headers, block in records(stream):
                    if headers["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    revisit = headers["warc-type"] == "revisit"
                    size = int(re.search(rb"(?i)content-length: *(\d+)", head)[1]) if revisit else len(body)
                    digest = headers["warc-payload-digest"].removeprefix("sha1:") if revisit else payload_digest(body)
                    out.append(
                        (
                            headers.get("x-page-id"),
                            headers.get("warc-target-uri"),
                            None if revisit else body,
                            size,
                            digest,
                            headers["warc-type"],
                            headers.get("x-refers-to-page-id"),
                        )
                    )
                    held += len(block)
                    if held > 4 << 20:
                        yield rows(out)
                        out, held = [], 0
            if out:
                yield rows(out)
