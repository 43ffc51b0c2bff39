"""Typed columns and two-valued conditions.

A missing value is NULL; in a DOUBLE column NaN is missing as well. Comparisons
never answer "unknown": a missing operand makes them false, and ``!=`` true. SQL's
three-valued logic gives the wrong answer as soon as a condition is negated or
stored, so conditions are carried as a ``Mask``: one column that is TRUE exactly
where the condition holds and one that is TRUE exactly where it does not. Either
may be NULL elsewhere, which a filter reads as false. That keeps both plain enough
(``a = 1``, ``a <> 1 OR a IS NULL``) to be pushed into a file scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TransformError
from tablewright.names import field

INT, FLOAT, TEXT, BOOL, TIME, NULL, OTHER = "int", "float", "text", "bool", "time", "null", "other"
NUMERIC = (INT, FLOAT, BOOL)

_KINDS: tuple[tuple[type[T.DataType] | tuple[type[T.DataType], ...], str], ...] = (
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), INT),
    ((T.FloatType, T.DoubleType), FLOAT),
    ((T.StringType, T.CharType, T.VarcharType), TEXT),
    (T.BooleanType, BOOL),
    (T.TimestampNTZType, TIME),
    (T.NullType, NULL),
)
_MISSING = object()


def kind_of(data_type: T.DataType) -> str:
    for types, kind in _KINDS:
        if isinstance(data_type, types):
            return kind
    return OTHER


@dataclass(frozen=True, eq=False)
class Value:
    """A column with its kind; ``constant`` holds the value where it is a literal.

    ``nan_free`` is set where NaN has been turned into NULL already. ``failed`` tells the
    rows for which there is no result although there should be one, ``reason`` why; they
    are NULL.
    """

    column: Column
    kind: str
    constant: Any = _MISSING
    nan_free: bool = False
    failed: Column | None = None
    reason: str = ""

    @property
    def is_constant(self) -> bool:
        return self.constant is not _MISSING

    @property
    def may_be_nan(self) -> bool:
        return self.kind == FLOAT and not self.is_constant and not self.nan_free

    def clean(self) -> Column:
        """The column with NaN turned into NULL."""
        if self.may_be_nan:
            return F.nanvl(self.column, F.lit(None).cast("double"))
        return self.column

    def missing(self) -> Column:
        if self.may_be_nan:
            return self.column.isNull() | F.isnan(self.column)
        return self.column.isNull()

    def present(self) -> Column:
        if self.may_be_nan:
            return self.column.isNotNull() & ~F.isnan(self.column)
        return self.column.isNotNull()

    def number(self) -> Value:
        """A numeric value wide enough to calculate with."""
        if self.kind == FLOAT:
            return Value(self.column.cast("double"), FLOAT, self.constant)
        if self.kind in (INT, BOOL):
            return Value(self.column.cast("bigint"), INT, self.constant)
        if self.kind == NULL:
            return Value(self.column.cast("double"), FLOAT)
        raise TransformError(f"A number is needed, not a {self.kind} value")


@dataclass(frozen=True, eq=False)
class Mask:
    """A condition: where it ``holds`` and where it ``fails``."""

    holds: Column
    fails: Column

    def __and__(self, other: Mask) -> Mask:
        return Mask(self.holds & other.holds, self.fails | other.fails)

    def __or__(self, other: Mask) -> Mask:
        return Mask(self.holds | other.holds, self.fails & other.fails)

    def __invert__(self) -> Mask:
        return Mask(self.fails, self.holds)

    def value(self) -> Value:
        """The condition as a column of TRUE and FALSE only."""
        return Value(F.coalesce(self.holds, F.lit(False)), BOOL)


ALWAYS, NEVER = (lambda: Mask(F.lit(True), F.lit(False))), (lambda: Mask(F.lit(False), F.lit(True)))


def literal(constant: Any) -> Value:
    """A configuration or expression literal."""
    if constant is None or constant != constant:
        return Value(F.lit(None), NULL, None)
    if isinstance(constant, bool):
        return Value(F.lit(constant), BOOL, constant)
    if isinstance(constant, int):
        if -(2**63) <= constant < 2**63:
            return Value(F.lit(constant), INT, constant)
        return Value(F.lit(float(constant)), FLOAT, float(constant))
    if isinstance(constant, float):
        return Value(F.lit(constant), FLOAT, constant)
    if isinstance(constant, str):
        return Value(F.lit(constant), TEXT, constant)
    raise TransformError(f"Unsupported literal: {constant!r}")


def column_value(frame: DataFrame, name: str) -> Value:
    """The named column of a frame; the caller has checked that it exists."""
    return Value(field(name), kind_of(frame.schema[name].dataType))


def as_mask(item: Value | Mask) -> Mask:
    if isinstance(item, Mask):
        return item
    if item.is_constant and item.kind != NULL:
        return ALWAYS() if item.constant else NEVER()
    if item.kind == NULL:
        return NEVER()
    if item.kind == BOOL:
        return Mask(item.column, ~F.coalesce(item.column, F.lit(False)))
    raise TransformError(f"A condition is needed, not a {item.kind} value")


def as_value(item: Value | Mask) -> Value:
    return item.value() if isinstance(item, Mask) else item


def common_kind(values: list[Value], *, phase: str, what: str) -> str:
    """The one kind that holds all values; mixing families is an error."""
    kinds = {value.kind for value in values} - {NULL}
    if not kinds:
        return NULL
    if len(kinds) == 1:
        return kinds.pop()
    if kinds <= {INT, FLOAT}:
        return FLOAT
    if kinds <= set(NUMERIC):
        return FLOAT if FLOAT in kinds else INT
    raise TransformError(f"{what} mixes {' and '.join(sorted(kinds))} values", phase=phase)


SPARK_TYPES = {INT: "bigint", FLOAT: "double", TEXT: "string", BOOL: "boolean", TIME: "timestamp_ntz"}


def as_kind(value: Value, kind: str) -> Column:
    """The column in the type of a kind from the same family."""
    if kind in SPARK_TYPES and (value.kind != kind or kind in (INT, FLOAT) or value.kind == NULL):
        return value.column.cast(SPARK_TYPES[kind])
    return value.column
