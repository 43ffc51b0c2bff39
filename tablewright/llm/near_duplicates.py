"""SimHash near-duplicates: 64-bit fingerprints linked by meet-in-the-middle ball hashing.

Two fingerprints at most three bits apart share a variant that lies within half that
distance of both. Since three is odd, one side goes a bit further than the other, and the
parity of a fingerprint's bits says which: two at an odd distance differ in parity.

* An even fingerprint emits itself and its variants with two bits flipped, an odd one its
  variants with one bit flipped: distances 1 and 3 meet. Of three bits two lie in the same
  half of the word, so pairs from one half are enough.
* An even fingerprint also emits its variants with one bit flipped: distance 2 meets, as
  it does for two odd ones.

Every variant thus joins fingerprints that are certainly linked, those with one flipped
bit being within two of each other and within three of all others: one link from each
to one of these is enough, and no pair is listed. Fingerprints being distinct, no variant
has more than 1,057 of them, however many documents are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.components import components
from tablewright.llm.places import Scratch, quoted
from tablewright.llm.texts import map_texts, mixed

BITS = 64
RADIUS = 3
#: Words of a shingle and seed of its hash.
SHINGLE = 3
SEED = 42
#: Variants that one bucket should hold; the number of buckets follows the input.
BUCKET_VARIANTS = 2 << 20
#: Fingerprints whose variants are made at once.
_BLOCK = 2048


def fingerprints(docs: DataFrame, name: str, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with a SimHash (long) of each text; no shuffle.

    A-Z become lower case. Words are runs of bytes other than space and \\t to \\r. Every
    shingle, repeats included, votes with its XXH64; with fewer words than a shingle has,
    the whole sequence is the one shingle. A bit is set if over half the votes have it.
    Null, empty and wordless texts get 0.
    """
    kind = T.StructType([T.StructField("value", T.LongType())])
    made = map_texts(docs, text, name, kind, lambda texts: [_simhash(texts, shingle)])
    return made.withColumn(name, quoted(name)["value"])


def near_duplicates(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest identity that links reach. Rows with equal identities
    are one node only through their fingerprints, and each stays a row. A null identity is
    never a component's id unless the component has no other.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = fingerprints(docs.select(quoted(identity).alias("doc_id"), quoted(text).alias("text")), "print")
    rows = scratch.keep(rows.select("doc_id", "print"), "fingerprints")
    nodes = scratch.keep(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    links = scratch.keep(ball_links(nodes), "links")
    roots = components(links, scratch)
    least = (
        nodes.join(roots, nodes["print"] == roots["node"], "left")
        .select("print", "least", F.coalesce("root", "print").alias("root"))
    )
    least = scratch.keep(least, "roots")
    by_root = scratch.keep(least.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = least.join(by_root, "root").select("print", "component_id")
    named = scratch.keep(named, "named")
    scratch.drop(links, by_root, least)
    return rows.join(named, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), BITS // 4, "0").alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame, identity: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose identity is their component's: one document of each group.

    Rows that share an identity are one document and stay or go together with it. Rows
    without identity stay only where their whole group has none.
    """
    found = near_duplicates(docs, identity, text)
    kept = found.where(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    kept = Scratch(docs.sparkSession).keep(kept, "kept")
    return docs.join(kept, quoted(identity).eqNullSafe(kept["kept_id"]), "left_semi")


def ball_links(nodes: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between the distinct fingerprints ``nodes.print`` up to three bits apart.

    Not all of them: enough that the linked ones, and no others, are connected.
    """
    buckets = max(1, -(-nodes.count() * (len(_EVEN) + len(_ODD)) // 2 // BUCKET_VARIANTS))
    emitted = nodes.select("print").mapInArrow(
        lambda batches: _emit(batches, buckets), "bucket int, variants binary, flips binary"
    )
    # Buckets are dealt by number; a bucket's size is bounded, as its count follows the input.
    linked = emitted.groupBy("bucket").applyInArrow(_meet, "a long, b long")
    return linked.distinct()


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """What an even and an odd fingerprint are combined with."""
    one = [1 << i for i in range(BITS)]
    half = BITS // 2
    two = [one[i] | one[j] for i in range(BITS) for j in range(i + 1, BITS) if i // half == j // half]
    return np.array([0, *one, *two], np.uint64), np.array(one, np.uint64)


_EVEN, _ODD = _masks()
#: The flips in the order of _EVEN; an odd fingerprint's one-bit flips have the same numbers.
_FLIPS = _EVEN


def _emit(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The variants of each fingerprint, packed by bucket: eight bytes and the flip's number."""
    for batch in batches:
        prints = np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)
        for first in range(0, len(prints), _BLOCK):
            block = prints[first : first + _BLOCK]
            odd = np.bitwise_count(block) % 2 == 1
            variants = np.concatenate(((block[~odd][:, None] ^ _EVEN).ravel(), (block[odd][:, None] ^ _ODD).ravel()))
            flips = np.concatenate(
                (
                    np.tile(np.arange(len(_EVEN), dtype=np.uint16), int((~odd).sum())),
                    np.tile(np.arange(1, BITS + 1, dtype=np.uint16), int(odd.sum())),
                )
            )
            bucket = (mixed(variants) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
            variants, flips = variants[order], flips[order]
            ends = np.cumsum(np.bincount(bucket, minlength=buckets))
            used = np.flatnonzero(np.diff(ends, prepend=0))
            spans = [(0 if b == 0 else int(ends[b - 1]), int(ends[b])) for b in used]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used.astype(np.int32)),
                    pa.array([variants[x:y].tobytes() for x, y in spans], pa.binary()),
                    pa.array([flips[x:y].tobytes() for x, y in spans], pa.binary()),
                ],
                names=["bucket", "variants", "flips"],
            )


def _meet(table: pa.Table) -> pa.Table:
    """The links of one bucket, thinned to a forest."""
    variants = np.frombuffer(b"".join(table.column("variants").to_pylist()), np.uint64)
    flips = np.frombuffer(b"".join(table.column("flips").to_pylist()), np.uint16)
    order = np.argsort(variants)
    variants, flips = variants[order], flips[order]
    group = np.concatenate(([0], np.cumsum(variants[1:] != variants[:-1])))
    sizes = np.bincount(group)
    shared = sizes[group] > 1
    variants, flips, group = variants[shared], flips[shared], group[shared]
    prints = variants ^ _FLIPS[flips]
    # The centre of a variant: one that is a single bit away, and so within three of all.
    single = (flips >= 1) & (flips <= BITS)
    centre = np.zeros(len(sizes), np.uint64)
    has = np.zeros(len(sizes), bool)
    centre[group[single]] = prints[single]
    has[group[single]] = True
    linked = has[group] & (prints != centre[group])
    pairs = np.stack([centre[group[linked]], prints[linked]])
    # Verified once more by their distance.
    pairs = np.unique(pairs[:, np.bitwise_count(pairs[0] ^ pairs[1]) <= RADIUS], axis=1)
    forest = spanning_forest(pairs[0].tolist(), pairs[1].tolist())
    ends = np.array(forest, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.table({"a": ends[:, 0], "b": ends[:, 1]})


def spanning_forest(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """As few of the links as connect what all of them connect."""
    above: dict[int, int] = {}

    def top(node: int) -> int:
        while (parent := above.get(node, node)) != node:
            above[node] = node = above.get(parent, parent)
        return node

    kept = []
    for a, b in zip(left, right, strict=True):
        x, y = top(a), top(b)
        if x != y:
            above[x] = y
            kept.append((a, b))
    return kept


def _simhash(texts: list[bytes], shingle: int) -> np.ndarray:
    hashes: list[int] = []
    counts = []
    digest = xxhash.xxh64_intdigest
    for text in texts:
        words = text.lower().split()
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes += [digest(joined, SEED)] if words else []
            counts.append(1 if words else 0)
            continue
        ends = np.cumsum([len(word) + 1 for word in words])
        firsts = [0, *ends[: len(words) - shingle].tolist()]
        lasts = (ends[shingle - 1 :] - 1).tolist()
        hashes += [digest(joined[x:y], SEED) for x, y in zip(firsts, lasts, strict=True)]
        counts.append(len(firsts))
    count = np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(texts)), count)
    lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
    # How often each text has each byte value in each of the eight bytes, then bits of those.
    of_byte = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
    result = np.zeros(len(texts), np.uint64)
    for lane in range(8):
        seen = np.bincount(owner * 256 + lanes[:, lane], minlength=len(texts) * 256).reshape(-1, 256)
        votes = seen.astype(np.float64) @ of_byte
        bits = np.packbits(2 * votes > count[:, None], axis=1, bitorder="little")[:, 0]
        result |= bits.astype(np.uint64) << np.uint64(8 * lane)
    return result.view(np.int64)
