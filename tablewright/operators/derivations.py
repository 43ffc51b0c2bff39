"""Computed columns, added one after another as ``deriv__name``."""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import TransformError
from tablewright.functions.expressions import Failure, dotted_names, evaluate
from tablewright.functions.text import as_text, regexp_replace
from tablewright.functions.values import NULL, TEXT, Value, as_kind, as_value, column_value, common_kind, literal
from tablewright.names import (
    is_config_column_reference,
    parse_qualified_column,
    resolve_column_reference,
    to_derivation_column,
    to_physical_column,
)
from tablewright.operators.conditions import condition_mask, find_column

if TYPE_CHECKING:
    from tablewright.spec import CaseDerivation, Derivation, RegexpReplaceDerivation

_PHASE = "derivations"
# What makes a CASE result an expression and not a plain text.
_EXPRESSION_SIGNS = re.compile(r"[+\-*/<>=!()]|\b(?:and|or)\b", re.IGNORECASE)


def apply_derivations(
    frame: DataFrame, derivations: Iterable[Derivation], failures: list[Failure] | None = None
) -> DataFrame:
    """Add each derivation in turn; later ones may use earlier ones.

    With ``failures``, columns that tell for which rows an expression fails are added to
    the frame and to that list. Whether anything uses the derivation makes no difference.
    """
    for derivation in derivations:
        if hasattr(derivation, "expression"):
            owner = to_derivation_column(derivation.variable_name)
            frame, outcome = evaluate(frame, derivation.expression, phase=_PHASE, failures=failures, owner=owner)
            value = as_value(outcome)
        elif hasattr(derivation, "pattern"):
            value = _replaced(frame, derivation)
        else:
            frame, value = _case(frame, derivation, failures)
        frame = frame.withColumn(to_derivation_column(derivation.variable_name), _typed(value))
    return frame


def _typed(value: Value) -> Column:
    return as_kind(value, value.kind) if value.kind != NULL else F.lit(None)


def _replaced(frame: DataFrame, derivation: RegexpReplaceDerivation) -> Value:
    source = column_value(frame, find_column(frame, derivation.source, phase=_PHASE))
    text = as_text(frame, source)
    return Value(regexp_replace(text, derivation.pattern, derivation.replacement), TEXT)


def _case(
    frame: DataFrame, derivation: CaseDerivation, failures: list[Failure] | None
) -> tuple[DataFrame, Value]:
    """The first branch whose condition holds decides. All branches are computed for all rows."""
    owner = to_derivation_column(derivation.variable_name)
    results = []
    for given in (*(branch.then for branch in derivation.branches), derivation.otherwise):
        frame, value = _result(frame, given, failures, owner)
        results.append(value)
    kind = common_kind(results, phase=_PHASE, what=f"CASE '{derivation.variable_name}'")
    if kind == NULL:
        return frame, literal(None)
    *thens, otherwise = (as_kind(value, kind) for value in results)
    column = F
    for branch, then in zip(derivation.branches, thens):
        column = column.when(condition_mask(frame, branch.when).holds, then)
    return frame, Value(column.otherwise(otherwise), kind)


def _result(
    frame: DataFrame, given: Any, failures: list[Failure] | None, owner: str
) -> tuple[DataFrame, Value]:
    """A branch result: a column, an expression or a literal.

    A text that reads like a column or an expression but names nothing in the table
    (``example.com``, ``N/A``) is a literal.
    """
    if not isinstance(given, str):
        return frame, literal(given)
    if is_config_column_reference(given):
        physical = resolve_column_reference(given)
        if physical in frame.columns:
            return frame, column_value(frame, physical)
        alias, _ = parse_qualified_column(given)
        if any(name.startswith(to_physical_column(alias, "")) for name in frame.columns):
            raise TransformError(f"Column not found for reference '{given}'", phase=_PHASE, column=physical)
        return frame, literal(given)
    if not _EXPRESSION_SIGNS.search(given):
        return frame, literal(given)
    try:
        frame, outcome = evaluate(frame, given, phase=_PHASE, failures=failures, owner=owner)
        return frame, as_value(outcome)
    except TransformError:
        if any(word in frame.columns for word in re.findall(r"\w+", given)) or any(
            to_physical_column(*pair) in frame.columns for pair in dotted_names(given)
        ):
            raise
        return frame, literal(given)
