"""Left, inner, right and full outer joins on column equality.

Missing keys match each other. Conditions that are not key equalities are applied to
the joined rows, not inside the join: one on the right table therefore drops the
unmatched rows of a left join.

Skew. Spark's adaptive execution splits a hot partition of an inner join on either
side, and of a left or right join on the side whose rows are all kept. It cannot
split the other side, nor any side of a full outer join. There, keys that are hot
are split here: their rows are dealt out over as many parts as their count asks for,
and the rows they may meet on the other side are repeated once per part. A repeated
row that meets nothing in its part has its partners in another one, so that lone
copy is dropped.

Looks. Hot keys are found by a sketch of the key columns that is filled while their
rows pass by; only its few candidates are counted exactly. Where a side is more than
files read and filtered (the result of an earlier join, above all), its rows pass by
while they are stored, and the join reads the stored table: what leads up to a side
runs once, however many joins follow. A table's rows have places then, which decide
on their parts, so that no column is read for that.

Missing keys. Spark joins on ``k <=> k`` by two derived columns, which hides how a
table is bucketed or sorted. If the joined table turns out to have no missing key,
plain equality gives the same rows. A look tells that as well; without one it is looked
up where the join has to shuffle, and for parquet the answer is in the file footers.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.errors import ErrorDetail, TransformError
from tablewright.functions.looks import reads_files
from tablewright.functions.values import NULL, NUMERIC, Value, column_value
from tablewright.names import field
from tablewright.operators.conditions import all_of, conjuncts, equated_columns, find_column
from tablewright.sources.storage import stored

if TYPE_CHECKING:
    from tablewright.spec import Condition

HOW = {"LEFT": "left", "INNER": "inner", "RIGHT": "right", "OUTER": "full"}
# Sides adaptive execution cannot split, by join type.
_UNSPLIT = {"left": ("right",), "inner": (), "right": ("left",), "full": ("left", "right")}
ROWS_PER_PART = 1_000_000
#: Keys that a sketch tracks: at most 100 kB a task come to the driver. A key with more
#: than a 500th of all rows is always found, and one with fewer by and by less surely.
TRACKED = 4096


@dataclass(frozen=True)
class JoinKeys:
    """Key columns by position, and the conditions left for the joined rows."""

    left: list[Value]
    right: list[Value]
    residual: list[Condition]


def apply_join(
    left: DataFrame,
    right: DataFrame,
    join_type: str,
    conditions: list[Condition],
    *,
    rows_per_part: int | None = None,
    probe: DataFrame | None = None,
) -> DataFrame:
    """Join two tables with distinct column names.

    ``rows_per_part`` forces the search for hot keys and sets how many rows of one key
    stay together; unset, keys are searched where a side is too large to broadcast.
    ``probe`` stands in for the right table where a look at a few rows is enough, so
    that a table whose rows are being counted is read in whole or not at all.
    """
    if join_type.upper() not in HOW:
        raise TransformError(f"Unsupported join type: {join_type}", phase="joins")
    how = HOW[join_type.upper()]
    keys = find_keys(left, right, conditions)
    frames = {"left": left, "right": right}
    unsplit = [side for side in _UNSPLIT[how] if rows_per_part or _is_large(frames[side])]
    if unsplit:
        joined = _split_join(left, right, keys, how, unsplit, rows_per_part or ROWS_PER_PART, right if probe is None else probe)
    elif not _is_large(right) or _has_missing_keys(right if probe is None else probe, keys.right):
        joined = left.join(right, _equal(zip(_clean(keys.left), _clean(keys.right))), how)
    else:
        joined = left.join(right, _same(zip(_columns(keys.left), _columns(keys.right))), how)
    if keys.residual:
        joined = joined.where(all_of(joined, keys.residual).holds)
    return joined


def find_keys(left: DataFrame, right: DataFrame, conditions: list[Condition]) -> JoinKeys:
    """Key pairs, and the conditions that say more than that two columns are equal.

    Key pairs count wherever AND alone leads to them. An entry that holds anything
    else besides is checked again as a whole afterwards, its keys included.
    """
    parts = [[equated_columns(part) for part in conjuncts(condition)] for condition in conditions]
    pairs = [pair for found in parts for pair in found if pair]
    if not pairs:
        raise TransformError(
            "Tables are joined on equal columns, and no condition names any",
            phase="joins",
            details=[ErrorDetail("name a column of each table and ==", "conditions")],
        )
    lefts, rights = zip(*(_orient(left, right, *pair) for pair in pairs))
    return JoinKeys(list(lefts), list(rights), [c for c, found in zip(conditions, parts, strict=True) if None in found])


def _orient(left: DataFrame, right: DataFrame, first: str, second: str) -> tuple[Value, Value]:
    """The two key columns, left table first; they may be written either way round."""
    for a, b in ((first, second), (second, first)):
        try:
            pair = (
                column_value(left, find_column(left, a, phase="joins")),
                column_value(right, find_column(right, b, phase="joins")),
            )
        except TransformError:
            continue
        kinds = {value.kind for value in pair} - {NULL}
        if len(kinds) > 1 and not kinds <= set(NUMERIC):
            raise TransformError(
                f"Cannot join {pair[0].kind} to {pair[1].kind} values: {first}, {second}", phase="joins"
            )
        return pair
    # Neither way works: name the column that is missing, or that both are on one side.
    for reference in (first, second):
        if reference not in left.columns and reference not in right.columns:
            known = left.select(*map(field, left.columns)).join(right.limit(0), F.lit(False), "left")
            find_column(known, reference, phase="joins")
    raise TransformError(f"A key needs a column of each table: {first}, {second}", phase="joins")


def _clean(values: list[Value]) -> list[Column]:
    return [value.clean() for value in values]


def _columns(values: list[Value]) -> list[Column]:
    return [value.column for value in values]


def _has_missing_keys(frame: DataFrame, keys: list[Value]) -> bool:
    missing = reduce(lambda a, b: a | b, [key.missing() for key in keys])
    return not frame.where(missing).isEmpty()


def _same(pairs) -> Column:
    """Equality for keys of which one side is never missing."""
    return reduce(lambda a, b: a & b, [a == b for a, b in pairs])


def _equal(pairs) -> Column:
    return reduce(lambda a, b: a & b, [a.eqNullSafe(b) for a, b in pairs])


# --- hot keys --------------------------------------------------------------------


@dataclass(frozen=True)
class Look:
    """What a pass over a side's keys has told: the side, its hot keys, whether some are missing."""

    frame: DataFrame
    hot: DataFrame | None
    missing: bool


def _split_join(
    left: DataFrame,
    right: DataFrame,
    keys: JoinKeys,
    how: str,
    unsplit: list[str],
    rows_per_part: int,
    probe: DataFrame,
) -> DataFrame:
    columns = left.columns + right.columns
    key_names = [f"key{i}" for i in range(len(keys.left))]
    frames, looks = {"left": left, "right": right}, {}
    for side, values in (("left", keys.left), ("right", keys.right)):
        own = {_own(side, name): column for name, column in zip(key_names, _clean(values))}
        if side in unsplit:
            looks[side] = _look(frames[side], own, rows_per_part, probe if side == "right" else left)
            frames[side] = looks[side].frame
        frames[side] = frames[side].withColumns(own)
    missing = looks["right"].missing if "right" in looks else _has_missing_keys(probe, keys.right)
    pairs = [(field(_own("left", name)), field(_own("right", name))) for name in key_names]
    match = _equal if missing else _same
    lone_copies = []
    for side, look in looks.items():
        if look.hot is None:
            continue
        other = "right" if side == "left" else "left"
        part, parts = f"__part_{side}", f"__parts_{side}"
        frames[side] = _deal(_mark(frames[side], look.hot, side, key_names, parts), part, parts)
        frames[other] = _repeat(_mark(frames[other], look.hot, other, key_names, parts), part, parts)
        frames[side] = frames[side].withColumn(f"__met_{side}", F.lit(True)).drop(parts)
        frames[side] = frames[side].withColumnRenamed(part, f"{part}_own")
        pairs.append((field(f"{part}_own"), field(part)))
        lone_copies.append(field(f"__met_{side}").isNull() & (field(parts) > 1))
    joined = frames["left"].join(frames["right"], match(pairs), how)
    for lone in lone_copies:
        joined = joined.where(~F.coalesce(lone, F.lit(False)))
    return joined.select(*map(field, columns))


def _look(frame: DataFrame, keys: dict[str, Column], rows_per_part: int, probe: DataFrame) -> Look:
    """One pass over a side: of files the key columns are read, of ``probe``; anything else is stored."""
    if reads_files(frame):
        candidates, missing = _passing_by(
            probe.select(*(column.alias(name) for name, column in keys.items())), list(keys), _run
        )
    else:
        tables: list[DataFrame] = []
        columns = frame.columns
        candidates, missing = _passing_by(
            frame.withColumns(keys), list(keys), lambda seen: tables.append(stored(seen.select(*map(field, columns))))
        )
        frame = tables[0]
    return Look(frame, _counted(frame.withColumns(keys), list(keys), candidates, rows_per_part), missing)


def hot_keys(frame: DataFrame, key_names: list[str], rows_per_part: int) -> DataFrame | None:
    """Keys with more than ``rows_per_part`` rows and the parts they need, or None."""
    candidates, _ = _passing_by(frame.select(*map(field, key_names)), key_names, _run)
    return _counted(frame, key_names, candidates, rows_per_part)


def _passing_by(
    frame: DataFrame, key_names: list[str], action: Callable[[DataFrame], object]
) -> tuple[list[tuple[int, int]], bool]:
    """Watch the keys of all rows that an action lets pass by.

    Gives the most frequent hashes of keys with their estimated rows, which are never too
    few, and whether a key is missing. Each task sends a sketch of bounded size.
    """
    keys = [field(name) for name in key_names]
    seen = Observation(f"keys {uuid.uuid4().hex}")
    action(
        frame.observe(
            seen,
            F.call_function("approx_top_k", F.xxhash64(*keys), F.lit(TRACKED), F.lit(TRACKED)).alias("top"),
            F.count_if(reduce(lambda a, b: a | b, [key.isNull() for key in keys])).alias("missing"),
        )
    )
    found = seen.get
    return [(item["item"], item["count"]) for item in found.get("top") or ()], bool(found.get("missing"))


def _run(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def _counted(
    frame: DataFrame, key_names: list[str], candidates: list[tuple[int, int]], rows_per_part: int
) -> DataFrame | None:
    """The exact numbers of parts of the candidates that are hot. There are no more than a sketch tracks."""
    likely = [item for item, rows in candidates if rows > rows_per_part]
    if not likely:
        return None
    keys = [field(name) for name in key_names]
    named = [key.alias(f"key{i}") for i, key in enumerate(keys)]
    counted = frame.where(F.xxhash64(*keys).isin(likely)).groupBy(*named).agg(F.count(F.lit(1)).alias("rows"))
    parts = F.ceil(F.col("rows") / rows_per_part).cast("int").alias("parts")
    hot = counted.where(F.col("rows") > rows_per_part).select(*(f"key{i}" for i in range(len(keys))), parts)
    rows = hot.collect()
    return frame.sparkSession.createDataFrame(rows, hot.schema) if rows else None


def _own(side: str, name: str) -> str:
    return f"__{side}_{name}"


def _mark(frame: DataFrame, hot: DataFrame, side: str, key_names: list[str], parts: str) -> DataFrame:
    """Say how many parts each row's key has. A sketch's candidates are few enough to broadcast."""
    named = hot.toDF(*[f"__hot_{name}" for name in key_names], parts)
    matched = _equal((field(_own(side, name)), field(f"__hot_{name}")) for name in key_names)
    marked = frame.join(F.broadcast(named), matched, "left").drop(*[f"__hot_{name}" for name in key_names])
    return marked.withColumn(parts, F.coalesce(field(parts), F.lit(1)))


def _deal(frame: DataFrame, part: str, parts: str) -> DataFrame:
    """Give each row one part, by its place in the files it is read from.

    No random number, and no column: a task run again reads the same rows in the same
    order and deals them the same way, and equal rows spread as well.
    """
    return frame.withColumn(part, F.pmod(F.monotonically_increasing_id(), field(parts)).cast("int"))


def _repeat(frame: DataFrame, part: str, parts: str) -> DataFrame:
    """Repeat each row once per part of its key."""
    return frame.withColumn(part, F.explode(F.sequence(F.lit(0), field(parts) - 1)))


def _is_large(frame: DataFrame) -> bool:
    """Whether Spark's estimate rules out a broadcast of this table."""
    limit = frame.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) > limit
