"""Spelling variants: words that differ by one code point, found through pairs of trie nodes.

The distinct words are put into two tries, one of the words and one of the words read
backwards, and the nodes are numbered. A word with its code point i skipped is then the
pair of two integers (node of what is before i, node of what is behind it), and a word
with a gap before its code point i is the pair (node of the i first, node of the rest).
Equal pairs of two skips are words with one code point replaced, and a pair of a skip and
a gap is a word with one code point more than the other: all neighbours, and no others.

A pair has one gap at most and one skip for each code point that can stand there, so what
meets is bounded by the alphabet. Pairs of words are never listed: of what meets, a word
needs the number of the others and the best of them.

Nodes are numbered in the order of the words: sorted, a word has the nodes of the prefix
it shares with its predecessor and new ones behind it. Tasks number ranges of words on
their own. Words with equal first code points (``_HEAD``) are in one range, so ranges share
short prefixes only, and where they do, the driver has the later range take over the
numbers: a few short lists a range.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.places import Scratch, quoted
from tablewright.llm.texts import utf8

#: Code points that decide on a word's range; ranges share less than that.
_HEAD = 64
#: Bytes of a text that are taken apart at once, and words a task counts before it passes them on.
CHUNK_BYTES = 4 << 20
COUNTED = 1 << 18
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_REST = re.compile("[A-Za-zÀ-ÿ]*")
#: Of all places of a run in the documents, every so-manieth by hash loses a code point.
DAMAGED = 97


def run_counts(
    docs: DataFrame, identity: str = "doc_id", text: str = "text", shortest: int = 5, least: int = 3, damaged: int = DAMAGED
) -> DataFrame:
    """``word n``: the runs of letters of all texts with their numbers, ``least`` occurrences at least.

    Runs are maximal runs of A-Z, a-z and U+00C0 to U+00FF; A-Z become lower case. Where
    ``damaged`` divides the CRC-32 of ``identity:run``, the code point that the CRC's
    remainder by the run's length names is left out. What has less than ``shortest`` code
    points then is left out. Null and empty texts have none, repeated rows count each, a
    null identity is an empty one.
    """
    rows = docs.select(
        F.coalesce(quoted(identity).cast("string"), F.lit("")).cast("binary").alias("doc"), utf8(quoted(text)).alias("text")
    )
    parts = rows.mapInArrow(lambda batches: _count_runs(batches, shortest, damaged), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def spelling_variants(words: DataFrame, word: str = "word", count: str = "n", times: int = 2) -> DataFrame:
    """``word form root n n_near form_n`` for each distinct word.

    Words are near that differ by one code point inserted, deleted or replaced;
    ``n_near`` counts those. ``form`` is the near word of the largest count, the first in
    code-point order of equal ones, if that count is ``times`` that of the word; else null,
    like ``form_n``, its count. ``root`` is where following the forms ends, the word itself
    without a form; counts grow along the way, so it does end. Counts of repeated words are
    added up; null and empty words and null counts are left out. An empty table gives none.
    """
    scratch = Scratch(words.sparkSession)
    distinct = words.select(quoted(word).cast("string").alias("word"), quoted(count).cast("long").alias("n"))
    distinct = distinct.where((F.col("word") != "") & F.col("n").isNotNull()).groupBy("word").agg(F.sum("n").alias("n"))
    numbered = with_nodes(distinct, "word", "prefixes", scratch)
    numbered = numbered.withColumnRenamed("prefixes_at", "id").withColumn("backwards", F.reverse("word"))
    numbered = with_nodes(numbered, "backwards", "suffixes", scratch).drop("suffixes_at", "backwards")
    numbered = scratch.keep(numbered, "words")
    known = numbered.select("id", "word", "n")
    near = scratch.keep(_neighbours(_pairs(numbered)), "near")
    linked = known.join(near, "id", "left").select(
        "id",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.m") >= times * F.col("n"), F.col("best.id")).alias("form_id"),
        F.when(-F.col("best.m") >= times * F.col("n"), -F.col("best.m")).alias("form_n"),
    )
    linked = scratch.keep(linked, "linked")
    roots = _roots(linked.where(F.col("form_id").isNotNull()).select("id", F.col("form_id").alias("root_id")), scratch)
    named = known.select(F.col("id").alias("of"), F.col("word").alias("name"))
    forms = named.select(F.col("of").alias("form_id"), F.col("name").alias("form"))
    ends = roots.join(named, F.col("root_id") == F.col("of")).select("id", F.col("name").alias("root"))
    # Words without a form are in no join: they would all meet in one task.
    columns = ("word", "form", "root", "n", "n_near", "form_n")
    alone = linked.where(F.col("form_id").isNull()).withColumn("form", F.lit(None).cast("string")).withColumn("root", F.col("word"))
    return linked.join(forms, "form_id").join(ends, "id").select(*columns).unionByName(alone.select(*columns))


def with_nodes(frame: DataFrame, text: str, name: str, scratch: Scratch) -> DataFrame:
    """The frame with the trie nodes of each text's prefixes, and with its place in the order of texts.

    ``name`` lists the numbers of the nodes from the empty prefix to the whole text; equal
    prefixes, and no others, have equal numbers. ``name``_at is the place, from 0. Texts
    are distinct and not null.
    """
    order = F.substring(quoted(text), 1, _HEAD)
    ranges = frame.repartitionByRange(order).sortWithinPartitions(text).withColumn("part", F.spark_partition_id())
    passed, column = len(ranges.columns), frame.columns.index(text)
    own = {"own": T.ArrayType(T.LongType()), "shared": T.IntegerType(), "row": T.LongType()}
    schema = T.StructType([*ranges.schema.fields, *(T.StructField(x, kind) for x, kind in own.items())])
    local = scratch.keep(ranges.mapInArrow(lambda batches: _number(batches, column, passed), schema), name)
    lists = F.struct("row", F.substring(quoted(text), 1, _HEAD).alias("head"), F.slice("own", 1, _HEAD + 1).alias("own"), "shared")
    summary = local.groupBy("part").agg(
        F.min(F.struct("row", F.substring(quoted(text), 1, _HEAD).alias("head"))).alias("first"),
        F.max_by(lists, "row").alias("last"),
        F.count("*").alias("rows"),
        F.sum(F.size("own")).alias("nodes"),
    )
    # One row a range, with a few times 64 code points or numbers.
    offsets = _offsets(summary.orderBy("part").collect())
    bases = frame.sparkSession.createDataFrame(offsets, "part int, node_base long, row_base long, taken array<long>")
    joined = local.join(F.broadcast(bases), "part")
    nodes = F.transform(
        "own",
        lambda x, i: F.when(i < F.least(F.col("shared") + 1, F.size("taken")), F.get("taken", i)).otherwise(x + F.col("node_base")),
    )
    return joined.select(*map(quoted, frame.columns), nodes.alias(name), (F.col("row") + F.col("row_base")).alias(f"{name}_at"))


def _offsets(ranges: list[T.Row]) -> list[tuple[int, int, int, list[int]]]:
    """For each range the numbers of nodes and rows before it, and the nodes that it shares with the range before.

    Only the last word before a range can share a prefix with it that its first word does
    not share, so what the first word shares with that is all.
    """
    found, nodes, rows = [], 0, 0
    head, last = "", []
    for part in ranges:
        taken = last[: _common(head, part.first.head) + 1] if found else []
        found.append((part.part, nodes, rows, taken))
        mine = min(part.last.shared + 1, len(taken))
        head = part.last.head
        last = taken[:mine] + [x + nodes for x in part.last.own[mine:]]
        nodes, rows = nodes + part.nodes, rows + part.rows
    return found


def _common(a: str, b: str) -> int:
    """Code points that both texts begin with."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    return next(k for k in range(most) if a[k] != b[k])


def _number(batches: Iterator[pa.RecordBatch], column: int, passed: int) -> Iterator[pa.RecordBatch]:
    """Nodes of a range of sorted texts: shared ones from the text before, new ones by running number."""
    before, nodes, shared, row, fresh = "", np.zeros(0, np.int64), 0, 0, 0
    for batch in batches:
        own, sizes, shares = [], [], []
        for text in batch.column(column).to_pylist():
            same = _common(before, text) + 1 if row else 0
            shared = min(shared, same - 1) if row else len(text)
            nodes = np.concatenate((nodes[:same], np.arange(fresh + same, fresh + len(text) + 1)))
            fresh += len(text) + 1
            before = text
            row += 1
            own.append(nodes)
            sizes.append(len(nodes))
            shares.append(shared)
        if not own:
            continue
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), pa.array(np.concatenate(own)))
        rows = pa.array(np.arange(row - len(own), row))
        columns = [*batch.columns[:passed], lists, pa.array(np.array(shares, np.int32)), rows]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:passed], "own", "shared", "row"])


def _pairs(words: DataFrame) -> DataFrame:
    """``prefix suffix m id skip first``: the pairs of each word, with a skipped code point or a gap.

    ``m`` is the negated count. ``first`` marks skips of the first of equal code points in
    a row: leaving out any of those gives the same word, which is to be met once.
    """
    length = F.size("prefixes") - 1
    letters = F.split("word", "")
    both = words.select("id", (-F.col("n")).alias("m"), "prefixes", "suffixes", length.alias("length"), letters.alias("letters"))

    def pair(i: Column, skipped: int) -> list[Column]:
        return [F.get("prefixes", i).alias("prefix"), F.get("suffixes", F.col("length") - i - skipped).alias("suffix")]

    skips = F.transform(
        F.sequence(F.lit(0), F.col("length") - 1),
        lambda i: F.struct(
            *pair(i, 1), F.lit(True).alias("skip"), ((i == 0) | (F.get("letters", i) != F.get("letters", i - 1))).alias("first")
        ),
    )
    gaps = F.transform(
        F.sequence(F.lit(0), F.col("length")), lambda i: F.struct(*pair(i, 0), F.lit(False).alias("skip"), F.lit(False).alias("first"))
    )
    return both.select("id", "m", F.explode(F.concat(skips, gaps)).alias("x")).select("x.prefix", "x.suffix", "m", "id", "x.skip", "x.first")


def _neighbours(pairs: DataFrame) -> DataFrame:
    """``id n_near best``: how many near words each word has, and the negated count and id of the best."""
    member = F.struct("m", "id", "skip", "first")
    met = pairs.groupBy("prefix", "suffix").agg(F.sort_array(F.collect_list(member)).alias("members")).where(F.size("members") > 1)
    met = met.select(
        "members",
        F.filter("members", lambda x: x["skip"]).alias("skips"),
        F.filter("members", lambda x: x["first"]).alias("firsts"),
        F.filter("members", lambda x: ~x["skip"]).alias("gaps"),
    )

    def offer(x: Column) -> Column:
        return F.when(x.isNotNull(), F.struct(x["m"].alias("m"), x["id"].alias("id")))

    def told(x: Column) -> Column:
        replaced = F.when(F.get("skips", F.lit(0))["id"] == x["id"], F.get("skips", F.lit(1))).otherwise(F.get("skips", F.lit(0)))
        shorter = F.when(x["first"], F.get("gaps", F.lit(0)))
        skip = F.struct(
            x["id"].alias("id"),
            (F.size("skips") - 1 + F.when(x["first"], F.size("gaps")).otherwise(0)).cast("long").alias("near"),
            F.array_min(F.array_compact(F.array(offer(replaced), offer(shorter)))).alias("best"),
        )
        gap = F.struct(x["id"].alias("id"), F.size("firsts").cast("long").alias("near"), offer(F.get("firsts", F.lit(0))).alias("best"))
        return F.when(x["skip"], skip).otherwise(gap)

    told_each = met.select(F.explode(F.transform("members", told)).alias("x")).where(F.col("x.near") > 0)
    return told_each.groupBy(F.col("x.id").alias("id")).agg(F.sum("x.near").alias("n_near"), F.min("x.best").alias("best"))


def _roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``id root_id``: the end of each path of links; every round halves what is left of the paths."""
    reached = scratch.keep(links, "roots")
    while True:
        further = reached.select(F.col("id").alias("root_id"), F.col("root_id").alias("further"))
        moved = reached.join(further, "root_id", "left").select(
            "id", F.coalesce("further", "root_id").alias("root_id"), F.col("further").isNotNull().alias("moved")
        )
        moved = scratch.keep(moved, "roots")
        scratch.drop(reached)
        if moved.where("moved").isEmpty():
            return moved.select("id", "root_id")
        reached = moved.select("id", "root_id")


def _count_runs(batches: Iterator[pa.RecordBatch], shortest: int, damaged: int) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()
    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            seed = zlib.crc32(doc.as_py() + b":")
            whole = bytes(text.as_buffer()).lower().decode("utf-8", "replace")
            for runs in _runs(whole):
                for run, n in Counter(runs).items():
                    size = len(run)
                    if size < shortest:
                        continue
                    value = zlib.crc32(run.encode(), seed)
                    if value % damaged == 0:
                        place = value % size
                        run = run[:place] + run[place + 1 :]
                        if size == shortest:
                            continue
                    counts[run] += n
                if len(counts) >= COUNTED:
                    yield _counted(counts)
                    counts.clear()
    yield _counted(counts)


def _runs(text: str) -> Iterator[list[str]]:
    """All runs of letters, chunk by chunk; a chunk ends with a run or between two."""
    start = 0
    while start < len(text):
        end = _REST.match(text, min(start + CHUNK_BYTES, len(text))).end()
        yield _RUN.findall(text, start, end)
        start = end


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
