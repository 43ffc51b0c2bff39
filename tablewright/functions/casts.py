"""Casts to the four target types, each with the condition under which it fails.

A cast never raises inside a task. It yields NULL and a failure flag, and the
quality gates count the flags, so a bad value is reported with its column name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import TransformError
from tablewright.functions import looks, times
from tablewright.functions.text import as_text, finest_unit
from tablewright.functions.values import BOOL, FLOAT, INT, NULL, TEXT, TIME, Value

STR, INT64, FLOAT64, DATETIME = "str", "int64", "float64", "datetime64[ns]"
CAST_TYPES = (STR, INT64, FLOAT64, DATETIME)
CAST_KINDS = {STR: TEXT, INT64: INT, FLOAT64: FLOAT, DATETIME: TIME}

# Matched before any try_cast: a cast that fails costs far more than a pattern that does.
_DIGITS = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
_INFINITY = r"^(?i)\s*[+-]?inf(?:inity)?\s*$"
_INT_LIMIT = float(2**63)


@dataclass(frozen=True, eq=False)
class Cast:
    """A cast column and what counts as a failure.

    ``required`` casts fail on every NULL result; ``checked`` ones where a source
    value, other than the ``blanks`` that mean "none", gave no result. ``frame`` is the
    frame the column belongs to: the given one, perhaps with helper columns.
    """

    frame: DataFrame
    column: Column
    required: bool = False
    checked: bool = False
    blanks: tuple[str, ...] = ()

    def failed(self, source: Column, result: Column) -> Column | None:
        """The failure condition over a source column and its cast; None if it cannot fail."""
        if self.required:
            return result.isNull()
        if not self.checked:
            return None
        given = source.isNotNull() & ~source.isin(*self.blanks) if self.blanks else source.isNotNull()
        return given & result.isNull()


def questions(value: Value, cast_to: str, layout: str | None = None) -> list[looks.Question]:
    """What a cast has to know of its whole column; most casts nothing."""
    if cast_to == STR and value.kind == TIME:
        return [finest_unit(value.column)]
    if cast_to == DATETIME and value.kind == TEXT and not layout:
        return times.layouts_of(value.clean())
    return []


def cast(
    frame: DataFrame,
    value: Value,
    cast_to: str,
    layout: str | None = None,
    name: str = "__cast",
    answers: list[Column] | None = None,
) -> Cast:
    """A value, best a plain column, in a target type; ``name`` begins any helper column's name.

    ``answers`` are those to the cast's ``questions``; without them the frame is asked.
    """
    if cast_to == STR:
        return Cast(frame, as_text(frame, value, answers[0] if answers else None))
    if cast_to == INT64:
        return _to_int(frame, value)
    if cast_to == FLOAT64:
        return _to_float(frame, value)
    if cast_to == DATETIME:
        return _to_time(frame, value, layout, name, answers)
    raise TransformError(f"Unsupported cast type '{cast_to}'", gate="G4", phase="mappings")


def read_double(text: Column) -> Column:
    """A double from text, NULL unless it is a plain number or an infinity.

    Spark alone would also read 1d, 0x1p3 and NaN.
    """
    number = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    infinity = F.when(text.rlike(_INFINITY), F.trim(text).try_cast("double"))
    return F.when(F.abs(number) != float("inf"), number).otherwise(infinity)


def read_bigint(text: Column) -> Column:
    """A BIGINT from text holding digits and a sign only, NULL otherwise."""
    return F.when(only_digits(text), text.try_cast("bigint"))


def only_digits(text: Column) -> Column:
    """Whether text is a whole number, however large."""
    return text.rlike(_DIGITS)


def truncated(number: Column) -> Column:
    """The BIGINT left of a double without its fraction; NULL where it is missing, infinite or too large."""
    return F.when((number > -_INT_LIMIT - 1) & (number < _INT_LIMIT), number.cast("bigint"))


def _to_int(frame: DataFrame, value: Value) -> Cast:
    """Whole numbers only; a missing value is a failure too."""
    source = value.clean()
    if value.kind in (INT, BOOL):
        return Cast(frame, source.cast("bigint"), required=True)
    if value.kind == NULL:
        return Cast(frame, F.lit(None).cast("bigint"), required=True)
    if value.kind == FLOAT:
        fits = (source == F.rint(source)) & (source >= -_INT_LIMIT) & (source < _INT_LIMIT)
        whole = F.when(fits, source.cast("bigint"))
    elif value.kind == TEXT:
        # Digits alone, as most are, need no detour.
        whole = F.coalesce(read_bigint(source), F.when(source.rlike(_NUMBER), _whole_number(source)))
    elif value.kind == TIME:
        raise TransformError("Timestamps cannot become whole numbers", gate="G4", phase="mappings")
    else:
        raise TransformError("Nested and binary values cannot become numbers", gate="G4", phase="mappings")
    return Cast(frame, whole, required=True, checked=True)


def _whole_number(text: Column) -> Column:
    """The BIGINT that a decimal or scientific number stands for, NULL if it has a fraction.

    Told by the digits: those behind the point, moved by the exponent, must all be zeros.
    """
    digits = F.regexp_replace(F.regexp_extract(text, r"^\s*[+-]?([0-9.]*)", 1), r"\.", "")
    behind = F.length(F.regexp_extract(text, r"\.([0-9]*)", 1))
    written = F.regexp_extract(text, r"[eE]([+-]?[0-9]+)", 1)
    exponent = F.when(written == "", 0).otherwise(written.try_cast("int"))
    zeros = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    number = text.try_cast("decimal(38,18)").try_cast("bigint")
    return F.when(digits.rlike("^0*$"), F.lit(0).cast("bigint")).when(zeros + exponent >= behind, number)


def _to_float(frame: DataFrame, value: Value) -> Cast:
    source = value.clean()
    if value.kind in (INT, FLOAT, BOOL, NULL):
        number = source.cast("int") if value.kind == BOOL else source
        return Cast(frame, number.cast("double"))
    if value.kind == TEXT:
        return Cast(frame, read_double(source), checked=True, blanks=("",))
    raise TransformError(f"A {value.kind} value cannot become a number", gate="G4", phase="mappings")


def _to_time(frame: DataFrame, value: Value, layout: str | None, name: str, answers: list[Column] | None) -> Cast:
    source = value.clean()
    if value.kind == TIME:
        return Cast(frame, source)
    if value.kind == NULL:
        return Cast(frame, F.lit(None).cast("timestamp_ntz"))
    if value.kind in (INT, FLOAT):
        return Cast(frame, times.from_nanos(source), checked=True)
    if value.kind == TEXT:
        if layout:
            moment = times.read_layout(source, layout)
        else:
            frame, moment = times.read_guessing(frame, source, name, answers)
        return Cast(frame, moment, checked=True, blanks=times.BLANKS)
    raise TransformError(f"A {value.kind} value cannot become a timestamp", gate="G4", phase="mappings")
