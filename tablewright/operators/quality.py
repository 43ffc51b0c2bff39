"""Quality gates: counted in one distributed aggregate, judged on the driver.

The counts are taken on the mapped table before any post-filter, so rows a
post-filter drops still count. They can be observed while the rows are written or
gathered by themselves; either way one row of numbers comes back, whatever the size
of the table. All that the gates ask of a count is whether it is zero, so a count
made too high by a task that ran twice does not change a verdict. What fails inside an
expression is counted like a failed cast, whether a mapping uses the expression or not.
"""

from __future__ import annotations

from collections.abc import Mapping as Numbers

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import ErrorDetail, TransformError
from tablewright.names import field
from tablewright.operators.mappings import MappedTable

ROWS = "rows"


def gate_counts(table: MappedTable) -> list[Column]:
    """The aggregates the gates need; columns no gate can stop are left out."""
    counts = [F.count(F.lit(1)).alias(ROWS)]
    for i, check in enumerate(table.checks):
        if check.required:
            counts.append(F.count(check.present).alias(f"present{i}"))
            counts.append(F.count_if(field(check.column).isNull()).alias(f"nulls{i}"))
        if check.failed is not None:
            counts.append(F.count_if(check.failed).alias(f"failed{i}"))
    for i, failure in enumerate(table.failures):
        counts.append(F.count_if(field(failure.column)).alias(f"broken{i}"))
    return counts


def judge(table: MappedTable, counts: Numbers[str, int | None]) -> None:
    """Raise for the first expression that fails, then for the first mapping, in declared order, that a gate stops."""

    def count(name: str) -> int:
        return counts.get(name) or 0

    for i, failure in enumerate(table.failures):
        if failures := count(f"broken{i}"):
            raise TransformError(
                f"Expression of '{failure.owner}' failed in {failures} rows: {failure.reason}",
                gate="G2",
                phase="execution",
                column=failure.owner,
                expression=failure.expression,
            )
    for i, check in enumerate(table.checks):
        if check.required and not count(f"present{i}"):
            raise _stopped("G3", check.column, "is required but entirely null")
        if failures := count(f"failed{i}"):
            raise TransformError(
                f"Cast to '{check.cast_to}' failed for column '{check.column}' in {failures} rows",
                gate="G4",
                phase="mappings",
                column=check.column,
                details=[ErrorDetail(check.cast_to, "cast_to")],
            )
        if check.required and (nulls := count(f"nulls{i}")):
            raise _stopped("G4", check.column, f"is required but null in {nulls} rows")


def gate_report(table: MappedTable) -> DataFrame:
    """One row per target column, and one per expression that can fail, with the numbers the gates look at; one pass.

    An expression has the name of what it computes, and failures only.
    """
    zero = F.lit(0).cast("bigint")
    totals, lines = [F.count(F.lit(1)).alias(ROWS)], []
    for i, check in enumerate(table.checks):
        failed = zero if check.failed is None else F.count_if(check.failed)
        totals += [
            F.count(check.present).alias(f"present{i}"),
            failed.alias(f"failed{i}") if check.failed is not None else F.max(zero).alias(f"failed{i}"),
            F.count_if(field(check.column).isNull()).alias(f"nulls{i}"),
        ]
        lines.append(
            F.struct(
                F.lit(check.column).alias("target_column"),
                F.col(ROWS).alias("row_count"),
                F.col(f"present{i}").alias("source_values"),
                F.coalesce(F.col(f"failed{i}"), zero).alias("cast_failures"),
                F.col(f"nulls{i}").alias("null_values"),
            )
        )
    for i, failure in enumerate(table.failures):
        totals.append(F.count_if(field(failure.column)).alias(f"broken{i}"))
        nothing = F.lit(None).cast("bigint")
        lines.append(
            F.struct(
                F.lit(failure.owner).alias("target_column"),
                F.col(ROWS).alias("row_count"),
                nothing.alias("source_values"),
                F.col(f"broken{i}").alias("cast_failures"),
                nothing.alias("null_values"),
            )
        )
    return table.staged.agg(*totals).select(F.inline(F.array(*lines)))


def has_rows(frame: DataFrame) -> bool:
    """Whether there is any row; reads no more than one."""
    return not frame.isEmpty()


def _stopped(gate: str, column: str, what: str) -> TransformError:
    return TransformError(f"Column '{column}' {what}", gate=gate, phase="mappings", column=column)
