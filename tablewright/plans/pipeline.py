"""Runs: every blueprint in order, each written only if its gates let it pass."""

from __future__ import annotations

import logging
import uuid
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import FileGuardError
from tablewright.operators import quality
from tablewright.plans.audit import CountingWatch, audit_table
from tablewright.plans.blueprint import errors_of, plan_blueprint
from tablewright.sources import sinks, storage
from tablewright.sources.tables import SourceTables, check_format, check_source
from tablewright.spec import Blueprint, FileOptions, Pipeline, load

_log = logging.getLogger(__name__)

RESULT_SCHEMA = "blueprint_id string, target string, path string, row_count bigint, bytes_written bigint"


@dataclass(frozen=True)
class BlueprintResult:
    blueprint_id: str
    target: str
    path: str
    row_count: int
    bytes_written: int


@dataclass
class RunResult:
    migration_id: str
    results: list[BlueprintResult] = field(default_factory=list)
    audit_rows: list[tuple] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(r.blueprint_id, r.target, r.path, r.row_count, r.bytes_written) for r in self.results]
        return spark.createDataFrame(rows, RESULT_SCHEMA)

    def audit(self, spark: SparkSession) -> DataFrame:
        """Rows before and after each step of each blueprint."""
        return audit_table(spark, self.audit_rows)


@dataclass(frozen=True)
class Validation:
    blueprints: int
    required_sources: list[str]
    targets: list[str]


def validate(
    spark: SparkSession,
    config: dict[str, Any] | Pipeline,
    *,
    sources: dict[str, DataFrame] | None = None,
    supplied: set[str] | None = None,
) -> Validation:
    """Gates G0 and G1: the configuration, its sources and its targets. No data is read.

    ``supplied`` names the source files at hand, where the caller knows them: one that
    is missing and one that no blueprint refers to are both errors.
    """
    pipeline = load(config)
    for connection in pipeline.connections.values():
        check_format(connection.file_options.format)
    _check_supplied(pipeline, supplied if supplied is not None else (set(sources) if sources else None), sources)
    tables = SourceTables(spark, pipeline, sources or {})
    for blueprint in pipeline.blueprints:
        for table in blueprint.tables:
            if table.file_name not in tables.frames:
                check_source(spark, tables.path(table), pipeline.connections[table.connection_ref].file_options)
        sinks.check_target_empty(spark, target_path(pipeline, blueprint), "G1")
    return Validation(len(pipeline.blueprints), sorted(pipeline.source_files()), pipeline.output_files())


def run(
    spark: SparkSession,
    config: dict[str, Any] | Pipeline,
    *,
    sources: dict[str, DataFrame] | None = None,
    dry_run: bool = False,
    persist_shared: bool = False,
) -> RunResult:
    """Run all blueprints in sequence. The first failure stops the run.

    Targets published before a failure stay. A dry run transforms and judges
    everything and writes nothing.
    """
    pipeline = load(config)
    validate(spark, pipeline, sources=sources)
    tables = SourceTables(spark, pipeline, sources or {}, persist=persist_shared)
    outcome = RunResult(pipeline.migration_id)
    try:
        for blueprint in pipeline.in_order():
            with errors_of(blueprint, pipeline):
                result = _run_blueprint(spark, pipeline, blueprint, tables, dry_run, outcome)
            outcome.results.append(result)
    finally:
        tables.release()
    return outcome


def target_path(pipeline: Pipeline, blueprint: Blueprint) -> str:
    connection = pipeline.connections[blueprint.target.connection_ref]
    return storage.join_path(connection.target_path, blueprint.target.file_name)


def _run_blueprint(
    spark: SparkSession,
    pipeline: Pipeline,
    blueprint: Blueprint,
    tables: SourceTables,
    dry_run: bool,
    outcome: RunResult,
) -> BlueprintResult:
    watch = CountingWatch()
    plan = plan_blueprint(blueprint, tables, watch)
    plan.check_root()
    path = target_path(pipeline, blueprint)
    options = pipeline.connections[blueprint.target.connection_ref].file_options
    if not dry_run:
        sinks.check_target_empty(spark, path, "G4")

    # One job computes, counts and writes; only then are the counts judged.
    gates = Observation(f"gates {uuid.uuid4().hex}")
    staged = plan.mapped.staged.observe(gates, *quality.gate_counts(plan.mapped))
    written = Observation(f"written {uuid.uuid4().hex}")
    target = plan.target_of(staged).observe(written, F.count(F.lit(1)).alias("rows"))
    if dry_run:
        target.write.format("noop").mode("overwrite").save()
        quality.judge(plan.mapped, gates.get)
        row_count, size = written.get.get("rows") or 0, 0
    else:
        row_count, size = _write_judged(spark, plan, gates, written, target, path, options)
    outcome.audit_rows += _audit_rows(pipeline, blueprint, plan, watch, gates, row_count, len(outcome.audit_rows))
    _log.info(
        "blueprint finished migration_id=%s client_id=%s blueprint_id=%s rows=%s bytes=%s dry_run=%s",
        pipeline.migration_id,
        pipeline.client_id,
        blueprint.blueprint_id,
        row_count,
        size,
        dry_run,
    )
    return BlueprintResult(blueprint.blueprint_id, blueprint.target.file_name, path, row_count, size)


def _write_judged(spark, plan, gates, written, target, path: str, options: FileOptions) -> tuple[int, int]:
    beside = sinks.staging_path(path)
    in_place = sinks.writes_in_place(spark, path, options)
    staging = path if in_place else beside
    storage.make_parent(spark, path)
    typed = beside + "-typed"
    leftovers = [beside, typed, beside + "-whole", beside + "-file", *([path] if in_place else [])]
    try:
        if plan.blueprint.joins and sinks.renders_in_two_steps(target, options):
            # Stored as it is first, so that looking through a column does not join again.
            target.write.parquet(typed)
            quality.judge(plan.mapped, gates.get)
            target = spark.read.schema(target.schema).parquet(typed)
        if in_place:
            sinks.open_target(spark, path)
        sinks.write_table(target, staging, options)
        quality.judge(plan.mapped, gates.get)
        row_count = written.get.get("rows") or 0
        size = sinks.publish(spark, staging, path, options, plan.mapped.columns)
        leftovers = [x for x in leftovers if x != path]
    finally:
        for leftover in leftovers:
            if storage.exists(spark, leftover):
                storage.delete(spark, leftover)
    sinks.verify(spark, path, options, plan.mapped.columns, row_count)
    return row_count, size


def _audit_rows(pipeline, blueprint, plan, watch, gates, row_count: int, position: int) -> list[tuple]:
    counts = watch.counts()
    counts.append(("mappings", "G4", gates.get.get(quality.ROWS) or 0))
    counts.append(("post_filters", "G4", row_count))
    rows, before = [], None
    for step, gate, after in counts:
        on_root = not step.startswith("pre_filters ")
        rows.append(
            (
                pipeline.migration_id,
                pipeline.client_id,
                blueprint.blueprint_id,
                gate,
                position + len(rows),
                step,
                before if on_root else None,
                after,
            )
        )
        before = after if on_root else before
    return rows


def _check_supplied(
    pipeline: Pipeline, supplied: set[str] | None, sources: dict[str, DataFrame] | None
) -> None:
    if supplied is None:
        return
    required = pipeline.source_files()
    if unknown := sorted(supplied - required):
        raise FileGuardError(f"No blueprint refers to these sources: {', '.join(unknown)}")
    # Frames may stand in for some files only; the others are looked for on disk.
    if sources is None and (missing := sorted(required - supplied)):
        raise FileGuardError(f"Missing sources: {', '.join(missing)}")
