"""Comparisons between typed values, as masks.

Families never mix by coercion: a number never equals a text, and ordering the two
is an error. Booleans compare as 0 and 1. A text literal next to a timestamp is
read as a timestamp.
"""

from __future__ import annotations

import datetime
import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablewright.errors import TransformError
from tablewright.functions.values import (
    ALWAYS,
    BOOL,
    FLOAT,
    INT,
    NEVER,
    NULL,
    NUMERIC,
    TEXT,
    TIME,
    Mask,
    Value,
    literal,
)

_APPLY = {
    "==": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
}
_OPPOSITE = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}


def compare(op: str, left: Value, right: Value) -> Mask:
    if op == "!=":
        return ~compare("==", left, right)
    left, right = _align(op, left, right)
    if NULL in (left.kind, right.kind):
        return NEVER()
    if not _comparable(left, right):
        if op == "==":
            return NEVER()
        raise TransformError(f"Cannot order {left.kind} against {right.kind} values", phase="predicates")
    a, b = left.column, right.column
    missing = [v.column.isNull() for v in (left, right) if not v.is_constant]
    nan = [F.isnan(v.column) for v in (left, right) if v.may_be_nan]
    if op == "==":
        # NaN equals NaN in Spark; one side being a number is enough to rule that out.
        if len(nan) == 2:
            return Mask((a == b) & ~nan[0], _any([a != b, *missing, nan[0]]))
        return Mask(a == b, _any([a != b, *missing]))
    # Spark sorts NaN above every number, so only the greater side can be wrong.
    greater = left if op in (">", ">=") else right
    holds = _APPLY[op](a, b)
    if greater.may_be_nan:
        holds = holds & ~F.isnan(greater.column)
    fails = [_APPLY[_OPPOSITE[op]](a, b), *missing]
    if greater.may_be_nan:
        fails.append(F.isnan(greater.column))
    return Mask(holds, _any(fails))


def is_missing(value: Value) -> Mask:
    return Mask(value.missing(), value.present())


def is_in(value: Value, options: list[Any]) -> Mask:
    """Membership in a list of literals; a null in the list matches missing values."""
    wanted, with_null = [], False
    for option in options:
        if option is None or option != option:
            with_null = True
            continue
        _, candidate = _align("==", value, literal(option))
        if _comparable(value, candidate):
            wanted.append(candidate.column)
    if value.kind == NULL:
        return ALWAYS() if with_null else NEVER()
    subject = value.column.cast("int") if value.kind == BOOL else value.column
    listed = subject.isin(*wanted) if wanted else F.lit(False)
    not_listed = ~subject.isin(*wanted) if wanted else F.lit(True)
    if with_null:
        return Mask(listed | value.missing(), not_listed & value.present())
    return Mask(listed, not_listed | value.column.isNull())


def between(value: Value, low: Value, high: Value, inclusive: str = "both") -> Mask:
    lower = compare(">=" if inclusive in ("both", "left") else ">", value, low)
    return lower & compare("<=" if inclusive in ("both", "right") else "<", value, high)


def moment(text: str) -> Value | None:
    """A timestamp literal written as ISO text."""
    try:
        parsed = datetime.datetime.fromisoformat(text.strip())
    except ValueError:
        return None
    return Value(F.lit(parsed.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz"), TIME, parsed)


def _align(op: str, left: Value, right: Value) -> tuple[Value, Value]:
    """Bring literals into the type of the column they are compared with."""
    for this, other in ((left, right), (right, left)):
        if this.kind == TIME and other.kind == TEXT and other.is_constant:
            parsed = moment(other.constant)
            if parsed is None:
                if op == "==":
                    return left, right
                raise TransformError(f"Not a timestamp: '{other.constant}'", phase="predicates")
            return (left, parsed) if this is left else (parsed, right)
        if this.kind == INT and other.kind == FLOAT and other.is_constant and other.constant.is_integer():
            if abs(other.constant) < 2**63:
                whole = literal(int(other.constant))
                return (left, whole) if this is left else (whole, right)
    if left.kind != right.kind and BOOL in (left.kind, right.kind):
        return _zero_one(left), _zero_one(right)
    return left, right


def _zero_one(value: Value) -> Value:
    if value.kind != BOOL:
        return value
    if value.is_constant:
        return literal(int(value.constant))
    return Value(value.column.cast("int"), INT)


def _comparable(left: Value, right: Value) -> bool:
    return left.kind == right.kind or (left.kind in NUMERIC and right.kind in NUMERIC)


def _any(conditions: list[Column]) -> Column:
    return reduce(operator.or_, conditions)
