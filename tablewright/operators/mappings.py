"""The target table: selected, renamed, defaulted and cast columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import TransformError
from tablewright.functions import casts
from tablewright.functions.compare import moment
from tablewright.functions.expressions import Failure, evaluate
from tablewright.functions.looks import asked
from tablewright.functions.text import as_text
from tablewright.functions.values import (
    NULL,
    NUMERIC,
    SPARK_TYPES,
    TEXT,
    TIME,
    Value,
    as_kind,
    as_value,
    column_value,
    common_kind,
    literal,
)
from tablewright.names import field
from tablewright.operators.conditions import find_column

if TYPE_CHECKING:
    from tablewright.spec import Mapping

_PHASE = "mappings"


@dataclass(frozen=True, eq=False)
class ColumnCheck:
    """What the gates need to know about one target column, over the staged table."""

    column: str
    cast_to: str
    required: bool
    present: Column
    failed: Column | None


@dataclass(frozen=True, eq=False)
class MappedTable:
    """The target columns, beside the source values that only the gates look at."""

    staged: DataFrame
    checks: tuple[ColumnCheck, ...]
    failures: tuple[Failure, ...] = ()

    @property
    def columns(self) -> list[str]:
        return [check.column for check in self.checks]

    def target(self, staged: DataFrame | None = None) -> DataFrame:
        return (self.staged if staged is None else staged).select(*map(field, self.columns))


def apply_mappings(
    frame: DataFrame,
    mappings: Sequence[Mapping],
    settle: Callable[[DataFrame], DataFrame] | None = None,
    failures: list[Failure] | None = None,
) -> MappedTable:
    """Map a table. Where a cast has to look at its whole column first, ``settle`` may
    store the mapped sources, so that what leads up to them runs only once.

    ``failures`` are columns of the frame that tell where its expressions failed; those of
    the mappings are added, and the gates count them all. Without that list, a mapping's
    expression that fails stops the job itself.
    """
    if not mappings:
        raise TransformError("At least one mapping is needed", phase=_PHASE)
    # Sources first, casts on top of them, so that a cast and its check share their work.
    values = []
    for mapping in mappings:
        frame, value = _source(frame, mapping, failures)
        values.append(_with_default(frame, value, mapping.default_value))
    names = [f"__source{i}" for i in range(len(mappings))]
    flags = [field(failure.column) for failure in failures or ()]
    sources = frame.select(*(_typed(value).alias(name) for value, name in zip(values, names)), *flags)
    cleans = [Value(field(name), value.kind, nan_free=True) for value, name in zip(values, names)]
    # What casts have to know of whole columns is asked for in one pass.
    questions = [casts.questions(clean, m.cast_to, m.datetime_format) for clean, m in zip(cleans, mappings)]
    if settle and any(questions):
        sources = settle(sources)
    sources, answers = asked(sources, [question for own in questions for question in own])
    outputs, kept, checks = [], [], []
    for mapping, clean, own, name in zip(mappings, cleans, questions, names):
        column = field(mapping.target_column)
        source = field(name)
        told, answers = answers[: len(own)], answers[len(own) :]
        try:
            cast = casts.cast(sources, clean, mapping.cast_to, mapping.datetime_format, name, told or None)
        except TransformError as error:
            error.column = error.column or mapping.target_column
            raise
        sources = cast.frame
        outputs.append(cast.column.alias(mapping.target_column))
        if cast.checked:
            kept.append(source)
        checks.append(
            ColumnCheck(
                column=mapping.target_column,
                cast_to=mapping.cast_to,
                required=not mapping.is_nullable,
                present=source if cast.checked else column,
                failed=cast.failed(source, column),
            )
        )
    return MappedTable(sources.select(*outputs, *kept, *flags), tuple(checks), tuple(failures or ()))


def _source(frame: DataFrame, mapping: Mapping, failures: list[Failure] | None) -> tuple[DataFrame, Value]:
    if mapping.source_type == "EXPRESSION":
        owner = mapping.target_column
        frame, outcome = evaluate(frame, mapping.source_value, phase=_PHASE, failures=failures, owner=owner)
        return frame, as_value(outcome)
    if mapping.source_type not in ("DIRECT", "DERIVED"):
        raise TransformError(f"Unsupported mapping source_type: {mapping.source_type}", phase=_PHASE)
    return frame, column_value(frame, find_column(frame, mapping.source_value, phase=_PHASE))


def _with_default(frame: DataFrame, value: Value, default: object) -> Value:
    """Missing values replaced; a default of another family turns the column into text."""
    if default is None:
        return value
    stand_in = literal(default)
    if value.kind == TIME and stand_in.kind == TEXT:
        stand_in = moment(stand_in.constant) or stand_in
    kinds = {value.kind, stand_in.kind} - {NULL}
    if len(kinds) == 1 or kinds <= set(NUMERIC):
        kind = common_kind([value, stand_in], phase=_PHASE, what="A default")
        filled = Value(value.clean(), value.kind)
        return Value(F.coalesce(as_kind(filled, kind), as_kind(stand_in, kind)), kind)
    return Value(F.coalesce(as_text(frame, value), as_text(frame, stand_in)), TEXT)


def _typed(value: Value) -> Column:
    clean = value.clean()
    return clean.cast(SPARK_TYPES[value.kind]) if value.kind in SPARK_TYPES else clean
