"""Row filters, before a join, after it or on the target table."""

from __future__ import annotations

from collections.abc import Iterable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from tablewright.functions.expressions import evaluate
from tablewright.functions.values import as_mask
from tablewright.names import field
from tablewright.operators.conditions import condition_mask

if TYPE_CHECKING:
    from tablewright.spec import Filter


def apply_filters(frame: DataFrame, filters: Iterable[Filter], *, phase: str = "filters") -> DataFrame:
    """Keep the rows all entries hold for; no entries keep every row.

    An entry sees the rows the entries before it left, which matters only where it
    asks for an aggregate of the whole column.
    """
    columns = frame.columns
    for item in filters:
        text = getattr(item, "value", None)
        if text is None:
            frame = frame.where(condition_mask(frame, item).holds)
            continue
        # An expression may join helper columns (ranks); they go once it is decided.
        widened, outcome = evaluate(frame, text, phase=phase)
        frame = widened.where(as_mask(outcome).holds)
        if widened.columns != columns:
            frame = frame.select(*map(field, columns))
    return frame
