"""One blueprint as one lazy plan."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from pyspark.errors import (
    AnalysisException,
    ArithmeticException,
    DateTimeException,
    IllegalArgumentException,
    NumberFormatException,
    SparkRuntimeException,
)
from pyspark.sql import DataFrame, SparkSession

from tablewright.errors import TablewrightError, TransformError
from tablewright.functions.expressions import Failure
from tablewright.operators import quality
from tablewright.operators.derivations import apply_derivations
from tablewright.operators.filters import apply_filters
from tablewright.operators.joins import apply_join
from tablewright.operators.mappings import MappedTable, apply_mappings
from tablewright.plans.audit import Watch
from tablewright.sources.tables import SourceTables, prefix_columns
from tablewright.spec import Blueprint, Pipeline, load


# What Spark raises over an expression or a value, as opposed to a lost file or executor.
_ABOUT_DATA = (
    AnalysisException,
    ArithmeticException,
    DateTimeException,
    IllegalArgumentException,
    NumberFormatException,
    SparkRuntimeException,
)


@contextmanager
def errors_of(blueprint: Blueprint, pipeline: Pipeline) -> Iterator[None]:
    """Errors leave with the blueprint they came from; Spark's own become gate G2 errors."""
    try:
        yield
    except TablewrightError as error:
        raise error.within(blueprint.blueprint_id, pipeline.migration_id) from error.__cause__
    except _ABOUT_DATA as problem:
        raise TransformError(
            str(problem).partition("\n")[0],
            phase="execution",
            blueprint_id=blueprint.blueprint_id,
            migration_id=pipeline.migration_id,
        ) from problem


@dataclass(frozen=True, eq=False)
class BlueprintPlan:
    """A planned blueprint: its root table, its mapped table and its target table."""

    blueprint: Blueprint
    root: DataFrame
    mapped: MappedTable
    target: DataFrame

    def target_of(self, staged: DataFrame) -> DataFrame:
        """The target table built on another plan of the mapped table."""
        return _post_filtered(self.blueprint, self.mapped.target(staged))

    def check_root(self) -> None:
        """Gate G2: the root table holds at least one row, before any filter."""
        if not quality.has_rows(self.root):
            raise TransformError(
                f"Root table has no rows: {self.blueprint.root.file_name}",
                phase="extract",
                blueprint_id=self.blueprint.blueprint_id,
            )

    def gate_report(self) -> DataFrame:
        return quality.gate_report(self.mapped)


def plan_blueprint(blueprint: Blueprint, sources: SourceTables, watch: Watch | None = None) -> BlueprintPlan:
    """Build the plan of a blueprint; references and types are checked on the way.

    Jobs run only where a plan depends on the data: the types of a delimited file, the
    hot keys of a large join, the order behind a rank.
    """
    watch = watch or Watch()
    with errors_of(blueprint, sources.pipeline):
        root = prefix_columns(sources.read(blueprint.root), blueprint.root.alias)
        working = apply_filters(root, blueprint.pre_filters, phase="pre_filters")
        working = watch.rows("pre_filters", working)
        for join in blueprint.joins:
            other = prefix_columns(sources.read(join.table), join.table.alias)
            counted = other
            if join.pre_filters:
                other = apply_filters(other, join.pre_filters, phase="pre_filters")
                counted = watch.rows(f"pre_filters {join.table.alias}", other)
            working = apply_join(working, counted, join.join_type, list(join.conditions), probe=other)
            working = watch.rows(f"join {join.table.alias}", working)
        failures: list[Failure] = []
        working = apply_derivations(working, blueprint.derivations, failures)
        # Without joins, reading a column again is cheaper than storing the table.
        mapped = apply_mappings(working, blueprint.mappings, watch.settle if blueprint.joins else None, failures)
        return BlueprintPlan(blueprint, root, mapped, _post_filtered(blueprint, mapped.target()))


def _post_filtered(blueprint: Blueprint, table: DataFrame) -> DataFrame:
    return apply_filters(table, blueprint.post_filters, phase="post_filters")


def transform(
    spark: SparkSession,
    config: dict[str, Any] | Pipeline,
    blueprint_id: str | None = None,
    *,
    sources: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """The target table of one blueprint, lazily and without its gates."""
    return plan(spark, config, blueprint_id, sources=sources).target


def plan(
    spark: SparkSession,
    config: dict[str, Any] | Pipeline,
    blueprint_id: str | None = None,
    *,
    sources: dict[str, DataFrame] | None = None,
) -> BlueprintPlan:
    pipeline = load(config)
    return plan_blueprint(pipeline.blueprint(blueprint_id), SourceTables(spark, pipeline, sources or {}))
