"""Structured conditions: predicates and AND/OR trees over them.

Every operator has a rule that says what its right side must be, and a builder that makes
its mask from the two sides. A negated operator is the opposite of another one's mask.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial, reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from tablewright.errors import ConfigValidationError, ErrorDetail, TransformError
from tablewright.functions.compare import compare, is_in, is_missing
from tablewright.functions.text import as_text, like
from tablewright.functions.values import NULL, TEXT, Mask, Value, column_value, literal
from tablewright.names import Reference

if TYPE_CHECKING:
    from tablewright.spec import Condition, Predicate

_PHASE = "predicates"


@dataclass(frozen=True)
class _Operator:
    """How a right side is read, how the mask is made of it, and whether it is turned round."""

    read: Callable[[DataFrame, Predicate], Any]
    mask: Callable[[DataFrame, Value, Any], Mask]
    negated: bool = False


def _nothing(frame: DataFrame, predicate: Predicate) -> None:
    return None


def _either(frame: DataFrame, predicate: Predicate) -> Value:
    """A constant, or another column of the frame."""
    if predicate.right_type != "column":
        return literal(_given(predicate))
    if not isinstance(_given(predicate), str):
        raise _refused(predicate, "names a column on its right, but not by text")
    return column_value(frame, find_column(frame, predicate.right))


def _constants(frame: DataFrame, predicate: Predicate) -> list:
    if predicate.right_type == "column" or not isinstance(_given(predicate), list):
        raise _refused(predicate, "compares with a list of constants, which is not there")
    return predicate.right


def _pattern(frame: DataFrame, predicate: Predicate) -> str:
    if _given(predicate) is not None and predicate.right_type == "column":
        raise _refused(predicate, "matches a constant pattern, not a column")
    return str(predicate.right)


def _given(predicate: Predicate) -> Any:
    if predicate.right is None:
        raise _refused(predicate, "has nothing on its right")
    return predicate.right


def _refused(predicate: Predicate, why: str) -> TransformError:
    return TransformError(f"{predicate.operator} on {predicate.left} {why}", phase=_PHASE)


def _matches(frame: DataFrame, value: Value, pattern: str) -> Mask:
    if value.kind == NULL:
        return ~is_missing(value)
    matched = like(as_text(frame, value), pattern, stored_text=value.kind == TEXT)
    return Mask(matched, ~matched | value.missing())


def _compares(sign: str) -> _Operator:
    return _Operator(_either, lambda frame, left, right: compare(sign, left, right))


# Operators a configuration may use.
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")
NULL_TESTS = ("IS_NULL", "IS_NOT_NULL")
LISTS = ("IN", "NOT_IN")
PATTERNS = ("LIKE", "NOT_LIKE")
# Other spellings of them.
_SPELLINGS = {"=": "==", "EQ": "==", "<>": "!=", "NE": "!=", "LT": "<", "LE": "<=", "GT": ">", "GE": ">="}

_OPERATORS: dict[str, _Operator] = {sign: _compares(sign) for sign in COMPARISONS}
for _pair, _rule, _build in (
    (NULL_TESTS, _nothing, lambda frame, left, right: is_missing(left)),
    (LISTS, _constants, lambda frame, left, right: is_in(left, right)),
    (PATTERNS, _pattern, _matches),
):
    _OPERATORS |= {name: _Operator(_rule, _build, negated) for name, negated in zip(_pair, (False, True), strict=True)}


def normalize_operator(operator: str) -> str:
    """The one spelling an operator has here, whatever its case and spacing."""
    written = "_".join(operator.upper().split())
    known = _SPELLINGS.get(written, written)
    if known not in _OPERATORS:
        raise ConfigValidationError(f"No such operator: {operator}")
    return known


def find_column(frame: DataFrame, reference: str, *, phase: str = _PHASE) -> str:
    """The frame's name for what a reference means: a name of its own, or ``alias.column``."""
    meant = Reference.dotted(reference)
    for name in (reference, meant.in_frame if meant else reference):
        if name in frame.columns:
            return name
    raise TransformError(
        f"The table has no column {reference}", phase=phase, column=name, details=[ErrorDetail(name, "column")]
    )


def predicate_mask(frame: DataFrame, predicate: Predicate) -> Mask:
    operator = _OPERATORS[normalize_operator(predicate.operator)]
    left = column_value(frame, find_column(frame, predicate.left))
    mask = operator.mask(frame, left, operator.read(frame, predicate))
    return ~mask if operator.negated else mask


def condition_mask(frame: DataFrame, item: Condition) -> Mask:
    """A predicate or a group of any depth."""
    if not hasattr(item, "conditions"):
        return predicate_mask(frame, item)
    if not item.conditions:
        raise TransformError("A group needs conditions", phase=_PHASE)
    return reduce(Mask.__and__ if item.logic == "AND" else Mask.__or__, map(partial(condition_mask, frame), item.conditions))


def all_of(frame: DataFrame, items: Iterable[Condition]) -> Mask:
    """Entries of a list hold together."""
    return reduce(Mask.__and__, (condition_mask(frame, item) for item in items))


def conjuncts(item: Condition) -> Iterator[Condition]:
    """What has to hold for the condition to hold: itself, or the parts of an AND at any depth."""
    pending = [item]
    while pending:
        part = pending.pop()
        if getattr(part, "logic", None) == "AND":
            pending.extend(reversed(part.conditions))
        else:
            yield part


def equated_columns(item: Condition) -> tuple[str, str] | None:
    """The two columns that a condition says are equal, if that is all it says."""
    if hasattr(item, "conditions") or item.right_type != "column" or not isinstance(item.right, str):
        return None
    return (item.left, item.right) if normalize_operator(item.operator) == "==" else None
