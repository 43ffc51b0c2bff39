"""Targets: written beside their place, judged, then moved there in one step.

Where the file system cannot move a folder in one step, as object stores cannot, part
files are written in their place below a marker, and taking the marker away publishes
them. A table with a marker is none: it cannot be read.

A target is a folder of part files, written by as many tasks as the data asks for.
``single_file`` asks for one file instead: the parts one behind the other.
"""

from __future__ import annotations

import uuid
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import FileGuardError, TablewrightError, WriteVerificationError
from tablewright.functions.looks import asked
from tablewright.functions.text import as_text, finest_unit
from tablewright.functions.values import TIME, column_value
from tablewright.names import field
from tablewright.sources import storage
from tablewright.sources.tables import PENDING, check_format, dialect, needs_multi_line, read_raw

if TYPE_CHECKING:
    from tablewright.spec import FileOptions

_MEGABYTE = 1024 * 1024
# As written, a missing value and an empty text are both an empty field.
_EMPTY = {"emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def check_target_empty(spark: SparkSession, path: str, gate: str) -> None:
    """A target must not exist, or hold nothing."""
    if storage.total_bytes(spark, path):
        kind: type[TablewrightError] = FileGuardError if gate == "G1" else WriteVerificationError
        raise kind(f"Target is not empty: {path}", gate=gate)


def staging_path(path: str) -> str:
    """A place next to the target, so that moving it there copies nothing."""
    return f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"


def writes_in_place(spark: SparkSession, path: str, options: FileOptions) -> bool:
    """Whether part files go to the target itself; a single file is made of parts written elsewhere."""
    if options.single_file or options.publish == "rename":
        return False
    return options.publish == "in_place" or not storage.renames_folders(spark, path)


def open_target(spark: SparkSession, path: str) -> None:
    """Begin a target in its place: from here on it is there, and no table."""
    check_target_empty(spark, path, "G4")
    if storage.exists(spark, path):
        storage.delete(spark, path)
    storage.touch(spark, storage.join_path(path, PENDING))


def write_table(frame: DataFrame, path: str, options: FileOptions) -> None:
    """Write all rows to a new folder, or to one that ``open_target`` has begun."""
    if check_format(options.format) == "PARQUET":
        frame.write.mode("append").parquet(path)
        return
    _write_text(rendered(frame), path, options)


def renders_in_two_steps(frame: DataFrame, options: FileOptions) -> bool:
    """Whether rendering needs to know a whole column first: timestamps written as text."""
    timestamps = any(column_value(frame, name).kind == TIME for name in frame.columns)
    return timestamps and check_format(options.format) == "CSV"


def rendered(frame: DataFrame) -> DataFrame:
    """The table as it prints, field by field."""
    only = len(frame.columns) == 1
    columns = frame.columns
    values = {name: column_value(frame, name) for name in columns}
    moments = [name for name in columns if values[name].kind == TIME]
    frame, answers = asked(frame, [finest_unit(values[name].column) for name in moments])
    units = dict(zip(moments, answers))

    def cell(name: str) -> Column:
        text = as_text(frame, values[name], units.get(name))
        # A line with nothing on it would be skipped when read again, so it is quoted.
        return (F.coalesce(text, F.lit("")) if only else text).cast("string").alias(name)

    return frame.select(*map(cell, columns))


def publish(spark: SparkSession, staged: str, path: str, options: FileOptions, columns: list[str]) -> int:
    """Move a finished folder to its target, or take the marker from one in its place; the bytes now there."""
    if staged == path:
        storage.delete(spark, storage.join_path(path, PENDING))
        return storage.total_bytes(spark, path)
    check_target_empty(spark, path, "G4")
    if options.single_file:
        staged = _merged(spark, staged, options, columns)
    if storage.exists(spark, path):
        storage.delete(spark, path)
    if not storage.rename(spark, staged, path):
        raise WriteVerificationError(f"Target cannot be put in place: {path}")
    return storage.total_bytes(spark, path)


def count_written(spark: SparkSession, path: str, options: FileOptions, columns: list[str]) -> int:
    """Rows found by reading a target again, with the options it was written with."""
    if check_format(options.format) == "PARQUET":
        return spark.read.parquet(path).count()
    settings = {**dialect(options), "multiLine": needs_multi_line(spark, path, options)}
    return read_raw(spark, path, settings, columns).select(field(columns[0])).count()


def verify(spark: SparkSession, path: str, options: FileOptions, columns: list[str], expected: int) -> None:
    """The target exists, is not empty and holds the rows that were written (G5)."""
    if not storage.exists(spark, path) or not storage.total_bytes(spark, path):
        # Without a header, a table without rows is a file without bytes.
        if not (expected == 0 and storage.exists(spark, path)):
            raise WriteVerificationError(f"Target is missing or empty: {path}", gate="G5")
    found = count_written(spark, path, options, columns)
    if found != expected:
        raise WriteVerificationError(f"Target holds {found} rows, not {expected}: {path}", gate="G5")


def _write_text(frame: DataFrame, path: str, options: FileOptions) -> None:
    settings = dict(_EMPTY)
    if len(frame.columns) == 1:
        settings["emptyValue"] = '""'
    frame.write.mode("append").options(**dialect(options), **settings).csv(path)


def _merged(spark: SparkSession, staged: str, options: FileOptions, columns: list[str]) -> str:
    """One file out of all parts; a limit on its size applies only where it is set."""
    size, limit = storage.total_bytes(spark, staged), options.max_single_file_mb
    if limit is not None and size > limit * _MEGABYTE:
        raise WriteVerificationError(f"{size} bytes are too many for a single file, the limit is {limit} MB")
    single = staged + "-file"
    if check_format(options.format) == "PARQUET":
        _rewritten(spark.read.parquet(staged), staged, single)
    else:
        _joined(spark, staged, single, options, columns)
    storage.delete(spark, staged)
    return single


def _rewritten(frame: DataFrame, staged: str, single: str) -> None:
    """Parquet files cannot be put one behind the other, so one task writes all rows anew."""
    whole = staged + "-whole"
    frame.coalesce(1).write.parquet(whole)
    (file, _), *others = storage.data_files(frame.sparkSession, whole)
    if others:
        raise WriteVerificationError(f"Expected one part file: {whole}")
    storage.rename(frame.sparkSession, file, single)
    storage.delete(frame.sparkSession, whole)


def _joined(spark: SparkSession, staged: str, single: str, options: FileOptions, columns: list[str]) -> None:
    """The part files byte by byte, the header and byte order mark of the first one only."""
    parts = sorted(storage.data_files(spark, staged))
    empty = staged + "-header"
    kind = ", ".join("`" + name.replace("`", "``") + "` STRING" for name in columns)
    _write_text(spark.createDataFrame([], kind).coalesce(1), empty, options)
    skip = max((size for _, size in storage.data_files(spark, empty)), default=0)
    storage.delete(spark, empty)
    filled = [file for file, size in parts if size > skip] or [file for file, _ in parts[:1]]
    storage.concatenate(spark, filled, single, skip)


