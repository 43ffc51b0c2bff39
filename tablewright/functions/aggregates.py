"""Whole-column aggregates and ranks, computed without gathering a column anywhere.

An aggregate is a scalar subquery: a distributed aggregation whose single value
Catalyst puts in place, and even hands to the file scan. Ranks need an order over all
values. They work on distinct values with their counts, range partitioned: each
partition adds up its own counts and is moved by the total of the partitions before
it, so no task ever sees more than one range. Exact quantiles need two places of the
order only: a sketch brackets them, and what lies in the bracket is counted. Nothing is
sorted or dealt by ranges for that, but its passes run while the plan is made.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tablewright.errors import TransformError
from tablewright.functions.looks import reads_files
from tablewright.functions.values import BOOL, FLOAT, INT, NULL, NUMERIC, TEXT, TIME, Value, as_kind
from tablewright.sources.storage import scratch_folder, stored

_SAME_KIND = {"min": F.min, "max": F.max}
_FLOATS = {"mean": F.avg, "std": F.stddev_samp, "var": F.var_samp}
_POPULATION = {"std": F.stddev_pop, "var": F.var_pop}
AGGREGATES = {*_SAME_KIND, *_FLOATS, "sum", "count", "nunique", "median", "quantile", "any", "all"}
#: Size of a sketch (its error is about a thousandth of the rows), and the margin that is
#: left around a place, as a share of the rows.
SKETCH = 2048
MARGIN = 0.003
#: Numbers in a bracket, on either side of a place, that the driver may be told one by one.
COUNTED = 20_000
RANK_METHODS = ("average", "min", "max", "dense")


def aggregate(
    frame: DataFrame, name: str, value: Value, probability: float = 0.5, ddof: int = 1
) -> Value:
    """One value for a whole column; missing values are skipped."""
    if name in ("median", "quantile"):
        return _quantile(frame, value, probability)
    if name in _FLOATS or name == "sum":
        if value.kind not in (*NUMERIC, NULL):
            raise TransformError(f"{name}() needs numbers, not {value.kind} values")
        value = value.number()
    if name in ("any", "all"):
        value = Value(value.number().column != 0 if value.kind in (INT, FLOAT) else value.column, BOOL)
    column, kind = F.col("value"), value.kind
    if name in _SAME_KIND:
        result = _SAME_KIND[name](column)
    elif name in _FLOATS:
        function = _POPULATION[name] if ddof == 0 and name in _POPULATION else _FLOATS[name]
        result, kind = function(column.cast("double")), FLOAT
    elif name == "sum":
        result = F.coalesce(F.sum(column), F.lit(0))
    elif name == "count":
        result, kind = F.count(column), INT
    elif name == "nunique":
        result, kind = F.count_distinct(column), INT
    else:
        result = F.bool_or(column) if name == "any" else F.bool_and(column)
        result = F.coalesce(result, F.lit(name == "all"))
    inputs = frame.select(value.clean().alias("value"))
    return Value(inputs.agg(result.alias("value")).scalar(), kind)


def add_rank(
    frame: DataFrame, value: Value, name: str, method: str = "average", percent: bool = False
) -> DataFrame:
    """The frame with each value's rank, ties sharing one; missing values stay unranked."""
    if value.kind not in (INT, FLOAT, TEXT, TIME, BOOL):
        raise TransformError(f"rank() does not apply to {value.kind} values")
    if method not in RANK_METHODS:
        raise TransformError(f"rank(method='{method}') depends on row order, which tables do not have")
    key, value_name = name + "_of", name + "_value"
    ordered = _ordered_counts(frame, value, value_name)
    last = F.col("up_to").cast("double")
    rank = {
        "average": last - (F.col("n") - 1) / 2,
        "min": last - F.col("n") + 1,
        "max": last,
        "dense": F.col("place").cast("double"),
    }[method]
    if percent:
        top = F.max("place") if method == "dense" else F.max("up_to")
        rank = rank / ordered.agg(top).scalar()
    ranks = ordered.select(value_name, rank.alias(name))
    marked = frame.withColumn(key, value.clean())
    return marked.join(ranks, marked[key] == ranks[value_name], "left").drop(key, value_name)


def _quantile(frame: DataFrame, value: Value, probability: float) -> Value:
    """The exact quantile, interpolated between neighbours."""
    if value.kind not in (*NUMERIC, NULL) or not 0 <= probability <= 1:
        raise TransformError("quantile() needs numbers and a probability from 0 to 1")
    column = _sketched(frame, Value(value.number().clean().cast("double"), FLOAT))
    if not column.rows:
        return Value(F.lit(None).cast("double"), FLOAT)
    position = (column.rows - 1) * probability
    places = math.floor(position), math.ceil(position)
    low, high = _at_places(column, *places)
    found = low if low == high else low + (high - low) * (position - places[0])
    return Value(F.lit(None if found != found else float(found)).cast("double"), FLOAT)


@dataclass(frozen=True, eq=False)
class Sketched:
    """The numbers of a column, how many there are, and values near any place in their order."""

    numbers: DataFrame
    rows: int
    near: Callable[[float], float]


def _sketched(frame: DataFrame, value: Value) -> Sketched:
    """A pass over a column that fills a sketch of its order, once for all quantiles asked of this very frame.

    Where more than files lead up to the column, its numbers are stored on the way, so
    that they need not be computed again.
    """
    known = frame.__dict__.setdefault("_tablewright_sketches", {})
    key = value.column._jc.toString()
    if key not in known:
        numbers = frame.select(value.column.alias("value")).where(F.col("value").isNotNull())
        facts = (F.count(F.lit(1)).alias("rows"), F.kll_sketch_agg_double("value", F.lit(SKETCH)).alias("sketch"))
        if reads_files(frame):
            row = numbers.agg(*facts).first().asDict()
        else:
            path, seen = scratch_folder(frame.sparkSession), Observation(f"numbers {uuid.uuid4().hex}")
            numbers.observe(seen, *facts).write.parquet(path)
            row, numbers = seen.get, frame.sparkSession.read.schema("value double").parquet(path)
        known[key] = Sketched(numbers, row.get("rows") or 0, _near(frame, row.get("sketch")))
    return known[key]


def _near(frame: DataFrame, sketch: bytes | bytearray | None) -> Callable[[float], float]:
    def near(share: float) -> float:
        one = F.kll_sketch_get_quantile_double(F.lit(bytes(sketch)), F.lit(min(1.0, max(0.0, share))))
        return frame.sparkSession.range(1).select(one).first()[0]

    return near


def _at_places(column: Sketched, low: int, high: int) -> tuple[float, float]:
    """The numbers at two neighbouring places (from 0) in the order of a column.

    The sketch names two values with the places between them. What is not above the upper
    one is counted: all that lies below the lower one together, and each distinct number
    between. If they turn out not to enclose the places, they are taken further apart; if
    too many numbers lie between, those are sketched again, and so on: every pass leaves
    about a hundredth.
    """
    numbers, rows, near, before, margin = column.numbers, column.rows, column.near, 0, MARGIN
    while True:
        bottom = near((low - before) / rows - margin) if low - before > margin * rows else -math.inf
        top = near((high - before + 1) / rows + margin) if (high - before + 1) / rows + margin < 1 else math.inf
        if rows * margin > COUNTED:
            within = (F.col("value") > bottom) & (F.col("value") < top)
            row = numbers.agg(
                F.count_if(F.col("value") < bottom).alias("below"),
                F.count_if(F.col("value") == bottom).alias("lowest"),
                F.count_if(within).alias("rows"),
                F.count_if(F.col("value") == top).alias("highest"),
                F.kll_sketch_agg_double(F.when(within, F.col("value")), F.lit(SKETCH)).alias("sketch"),
            ).first()
            start = before + row.below
            first, last = start + row.lowest, start + row.lowest + row.rows
            if not start <= low or not high < last + row.highest:
                margin *= 2
            elif high < first:
                return bottom, bottom
            elif low >= last:
                return top, top
            elif low < first or high >= last:
                # The two places are on either side of an end.
                return _at_places(column, low, low)[0], _at_places(column, high, high)[0]
            else:
                numbers, rows, before, near = numbers.where(within), row.rows, first, _near(numbers, row.sketch)
            continue
        # Few enough to be told one by one: the distinct numbers between, with their counts.
        told = F.when(F.col("value") >= bottom, F.col("value"))
        counts = numbers.where(F.col("value") <= top).groupBy(told.alias("value")).count().collect()
        end, found = before, {}
        for row in sorted(counts, key=lambda x: (x.value is not None, x.value or 0.0)):
            start, end = end, end + row["count"]
            if row.value is not None:
                found |= {place: row.value for place in (low, high) if start <= place < end}
        if len(found) == len({low, high}):
            return found[low], found[high]
        margin *= 2


def _ordered_counts(frame: DataFrame, value: Value, name: str) -> DataFrame:
    """Distinct values with their count ``n``, the count ``up_to`` them and their ``place``.

    The range partitioning is fixed by a stored table: range bounds are sampled, and a
    second evaluation, or a lost executor, could draw others.
    """
    kind = value.kind
    column = as_kind(Value(value.clean(), kind), kind)
    counts = (
        frame.select(column.alias(name))
        .where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranges = stored(counts.repartitionByRange(name).select("*", F.spark_partition_id().alias("range")))
    # One row per partition: the number of partitions bounds it, not the data.
    totals = ranges.groupBy("range").agg(F.sum("n").alias("n_range"), F.count(F.lit(1)).alias("places"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "range",
        F.coalesce(F.sum("n_range").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("places").over(before), F.lit(0)).alias("places_before"),
    )
    within = Window.partitionBy("range").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
    return ranges.join(F.broadcast(offsets), "range").select(
        name,
        "n",
        (F.col("n_before") + F.sum("n").over(within)).alias("up_to"),
        (F.col("places_before") + F.row_number().over(within)).alias("place"),
    )
