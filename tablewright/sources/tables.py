"""Source tables: parquet as it is typed, delimited text typed by what it holds.

Delimited text is read as text first. One pass over it finds, for every column at
once, whether all values are whole numbers, numbers or booleans, and whether any row
has too many fields. A declared schema spares the type search.
"""

from __future__ import annotations

import codecs
import csv
import re
from dataclasses import dataclass
from dataclasses import field as attribute
from functools import reduce
from typing import TYPE_CHECKING
from urllib.parse import unquote

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import ConfigValidationError, FileGuardError
from tablewright.functions.casts import only_digits, read_bigint, read_double
from tablewright.functions.text import WHITESPACE
from tablewright.names import field, prefix_source_columns
from tablewright.sources import storage

if TYPE_CHECKING:
    from tablewright.spec import FileOptions, Pipeline, Table

#: What a target has in it while its rows are written in their place.
PENDING = "_tablewright_pending"
# Unquoted or quoted fields that stand for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
FORMATS = ("CSV", "PARQUET")
_MALFORMED = "__malformed"
# Python encodings that Spark calls otherwise.
_CHARSETS = {
    "ascii": "us-ascii",
    "iso8859-1": "iso-8859-1",
    "utf-8-sig": "utf-8",
    "utf-16-le": "utf-16le",
    "utf-16-be": "utf-16be",
}
_MEGABYTE = 1024 * 1024
# Decimal digits that a DOUBLE and a BIGINT hold whatever they are.
_DOUBLE_DIGITS, _BIGINT_DIGITS = 15, 18


@dataclass
class SourceTables:
    """Reads the tables of a pipeline, each file once however many blueprints use it.

    ``frames`` supplies tables by file name instead of files. A file's column types
    are found once; its rows are read per use, so that every use prunes and filters
    its own scan, unless ``persist`` asks to keep files used more than once.
    """

    spark: SparkSession
    pipeline: Pipeline
    frames: dict[str, DataFrame] = attribute(default_factory=dict)
    persist: bool = False
    _read: dict[tuple[str, str, str | None], DataFrame] = attribute(default_factory=dict)
    _kept: list[DataFrame] = attribute(default_factory=list)

    def path(self, table: Table) -> str:
        """A source lies in the base path of its own connection."""
        return storage.join_path(self.pipeline.connections[table.connection_ref].base_path, table.file_name)

    def read(self, table: Table) -> DataFrame:
        """A table with its own column names."""
        key = (table.connection_ref, table.file_name, table.schema)
        if key not in self._read:
            self._read[key] = self._keep(table, self._load(table))
        return self._read[key]

    def release(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    def _load(self, table: Table) -> DataFrame:
        if table.file_name in self.frames:
            return plain_types(self.frames[table.file_name])
        options = self.pipeline.connections[table.connection_ref].file_options
        return read_table(self.spark, self.path(table), options, table.schema)

    def _keep(self, table: Table, frame: DataFrame) -> DataFrame:
        users = sum(table.file_name in {t.file_name for t in b.tables} for b in self.pipeline.blueprints)
        if self.persist and users > 1:
            frame = frame.persist()
            self._kept.append(frame)
        return frame


def read_table(spark: SparkSession, path: str, options: FileOptions, schema: str | None = None) -> DataFrame:
    """Read a file or folder in a connection's format."""
    kind = check_format(options.format)
    check_source(spark, path, options)
    try:
        if kind == "PARQUET":
            return plain_types(spark.read.parquet(path))
        return read_delimited(spark, path, options, schema)
    except (AnalysisException, IllegalArgumentException) as problem:
        raise FileGuardError(f"Source cannot be read: {path}: {problem}") from problem


def check_format(name: str) -> str:
    if name.upper() not in FORMATS:
        raise ConfigValidationError(f"Unsupported file format: {name}")
    return name.upper()


def check_source(spark: SparkSession, path: str, options: FileOptions) -> None:
    """A source has to exist and, where a limit is set, not exceed it."""
    if not storage.exists(spark, path) and not storage.matches(spark, path):
        raise FileGuardError(f"Source file not found: {path}")
    if storage.exists(spark, storage.join_path(path, PENDING)):
        raise FileGuardError(f"Source is not complete, its run has not published it: {path}")
    limit = options.max_file_size_mb
    if limit is not None and (size := storage.total_bytes(spark, path)) > limit * _MEGABYTE:
        raise FileGuardError(f"Source file of {size} bytes exceeds {limit} MB: {path}")


def prefix_columns(frame: DataFrame, alias: str) -> DataFrame:
    """Every column as ``alias__column``."""
    return frame.toDF(*prefix_source_columns(frame.columns, alias))


def plain_types(frame: DataFrame) -> DataFrame:
    """Types the library calculates with; columns that have them are left alone."""

    def plain(column: T.StructField) -> Column:
        kind = column.dataType
        if isinstance(kind, T.DecimalType) and kind.precision > _DOUBLE_DIGITS:
            if kind.scale or kind.precision > _BIGINT_DIGITS:
                raise FileGuardError(f"{column.name} is {kind.simpleString()}, which no type here holds exactly")
            return field(column.name).cast("bigint").alias(column.name)
        if isinstance(kind, (T.DecimalType, T.FloatType)):
            return field(column.name).cast("double").alias(column.name)
        if isinstance(column.dataType, (T.TimestampType, T.DateType)):
            return field(column.name).cast("timestamp_ntz").alias(column.name)
        return field(column.name)

    return frame.select(*map(plain, frame.schema.fields))


# --- delimited text --------------------------------------------------------------


def dialect(options: FileOptions) -> dict[str, object]:
    """Reader and writer options of a connection; doubled quotes stand for one."""
    return {
        "sep": options.delimiter,
        "quote": options.quote_char,
        "escape": options.quote_char,
        "encoding": _charset(options.encoding),
        "header": options.header_row,
    }


def _charset(encoding: str) -> str:
    """Python's name of an encoding as Spark knows it."""
    try:
        name = codecs.lookup(encoding).name
    except LookupError:
        return encoding
    return _CHARSETS.get(name, name)


def read_delimited(
    spark: SparkSession, path: str, options: FileOptions, schema: str | None = None
) -> DataFrame:
    settings = dialect(options)
    files = look_at_files(spark, path, options)
    names = _column_names(spark, files.any, {**settings, "multiLine": bool(files.whole)}, options.header_row)
    _check_headers(files, names, options, path)
    raw = _read_files(spark, files, settings, names)
    cells = raw.select(*(_cell(name) for name in names), field(_MALFORMED))
    types = T._parse_datatype_string(schema) if schema else None
    if types is not None and len(types.fields) != len(names):
        raise FileGuardError(f"The declared schema has {len(types.fields)} columns, not {len(names)}: {path}")
    facts = cells.agg(*_facts(names, settings, infer=types is None)).first()
    if facts["long_rows"]:
        raise FileGuardError(f"{facts['long_rows']} rows have more than {len(names)} fields: {path}")
    if facts["blank_rows"]:
        # Spark refuses to read the text of malformed rows alone, so the condition looks at a column too.
        cells = cells.where(_is_row() & (F.length(F.coalesce(field(names[0]), F.lit(""))) >= 0))
    if types is not None:
        declared = [
            field(name).cast(column.dataType).alias(column.name) for name, column in zip(names, types.fields)
        ]
        return plain_types(cells.select(*declared))
    return cells.select(*(_typed(name, i, facts) for i, name in enumerate(names)))


def read_raw(spark: SparkSession, path: str | list[str], settings: dict[str, object], names: list[str]) -> DataFrame:
    """All fields as text, with the text of rows that have another number of fields."""
    fields = [T.StructField(name, T.StringType()) for name in (*names, _MALFORMED)]
    return (
        spark.read.options(**settings, mode="PERMISSIVE", columnNameOfCorruptRecord=_MALFORMED)
        .schema(T.StructType(fields))
        .csv(path)
    )


def _read_files(spark: SparkSession, files: Files, settings: dict[str, object], names: list[str]) -> DataFrame:
    """All rows: of files that lines split, and of those that have to be read whole."""
    parts = [
        read_raw(spark, paths, {**settings, "multiLine": whole}, names)
        for paths, whole in ((files.split, False), (files.whole, True))
        if paths
    ]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Files:
    """The files of a source by how they are read, and the first lines that they have."""

    split: list[str]
    whole: list[str]
    heads: tuple[str, ...] = ()

    @property
    def any(self) -> str:
        return [*self.whole, *self.split][0]


def look_at_files(spark: SparkSession, path: str, options: FileOptions) -> Files:
    """One pass over the lines of all files: which may hold line breaks in fields, and how each begins.

    What a file holds decides, never its size, and each file by itself. A quote opens a
    field only where a field begins, and two of them inside stand for one. If every line,
    begun outside quotes, also ends outside, then each does begin outside and no field
    holds a line break. Otherwise, and where that cannot be told, a file is read whole.
    """
    wide = _charset(options.encoding).startswith(("utf-16", "utf-32"))
    whole = options.multi_line == "always" or (options.multi_line == "auto" and wide)
    known = options.multi_line != "auto" or wide
    lines = spark.read.text(path)
    if known and (wide or not options.header_row or len(lines.inputFiles()) < 2):
        return Files([], [path]) if whole else Files([path], [])
    quote, sep = re.escape(options.quote_char), re.escape(options.delimiter)
    begins = f"(^|{sep}){quote}"
    closed = f"{begins}[^{quote}]*+(?:{quote}{quote}[^{quote}]*+)*+{quote}(?={sep}|$)"
    left_open = F.contains("value", F.lit(options.quote_char)) & F.regexp_replace("value", closed, "$1").rlike(begins)
    # A file's first block is read by one task in order; nothing else says how it begins.
    first = F.first(F.when(F.col("_metadata.file_block_start") == 0, F.col("value")), ignorenulls=True)
    found = (
        lines.groupBy(F.col("_metadata.file_path").alias("file"))
        .agg(F.max(F.lit(whole) if known else left_open).alias("whole"), first.alias("head"))
        .collect()  # a row per file, as the driver lists them anyway
    )
    heads = tuple(sorted({row["head"].removeprefix("\ufeff").removesuffix("\r") for row in found if row["head"]}))
    if len({row["whole"] for row in found}) < 2:
        whole = bool(found and found[0]["whole"])
        return Files([], [path], heads) if whole else Files([path], [], heads)
    parts = {flag: [unquote(row["file"]) for row in found if row["whole"] is flag] for flag in (False, True)}
    return Files(sorted(parts[False]), sorted(parts[True]), heads)


def needs_multi_line(spark: SparkSession, path: str, options: FileOptions) -> bool:
    """Whether fields of a source may hold line breaks, which keeps those files from being split."""
    if options.multi_line != "auto":
        return options.multi_line == "always"
    return bool(look_at_files(spark, path, options).whole)


def _check_headers(files: Files, names: list[str], options: FileOptions, path: str) -> None:
    """All files of a folder have the same columns in the same order."""
    if not options.header_row or len(files.heads) < 2:
        return
    for head in files.heads:
        if len(options.delimiter) == 1:
            cells = next(csv.reader([head], delimiter=options.delimiter, quotechar=options.quote_char), [])
        else:
            cells = head.replace(options.quote_char, "").split(options.delimiter)
        # A header with line breaks in it goes on in the next line; its first line is compared.
        expected = names[: len(cells)] if files.whole and len(cells) < len(names) else names
        if [cell or f"Unnamed: {i}" for i, cell in enumerate(cells)] != expected:
            raise FileGuardError(f"A file's columns are not those of the others, {', '.join(names)}, but {head}: {path}")


def _column_names(spark: SparkSession, path: str, settings: dict[str, object], header: bool) -> list[str]:
    first = spark.read.options(**{**settings, "header": False}).csv(path).head(1)
    if not first:
        raise FileGuardError(f"Source file is empty: {path}")
    cells = list(first[0])
    if not header:
        return [str(i) for i in range(len(cells))]
    names = [f"Unnamed: {i}" if cell is None else cell for i, cell in enumerate(cells)]
    names[0] = names[0].removeprefix("\ufeff")
    repeated = {name for name in names if names.count(name) > 1}
    if repeated:
        raise FileGuardError(f"Repeated column names {sorted(repeated)}: {path}")
    return names


def _is_row() -> Column:
    """False for lines of white space only."""
    return field(_MALFORMED).isNull() | (F.btrim(field(_MALFORMED), F.lit(WHITESPACE)) != "")


def _cell(name: str) -> Column:
    return F.when(~field(name).isin(*NULL_TOKENS), field(name)).alias(name)


def _facts(names: list[str], settings: dict[str, object], infer: bool) -> list[Column]:
    """What one pass has to find out about all columns."""
    # Only rows already marked are read again, with room for one more field. Empty fields
    # are filled first, so that the additional one shows even if nothing is in it.
    marked, sep = field(_MALFORMED), str(settings["sep"])
    filled = F.regexp_replace(marked, re.escape(sep) + r"(?=" + re.escape(sep) + r"|\s*$)", sep.replace("$", r"\$") + "_")
    again = F.from_csv(
        filled,
        F.lit(", ".join(f"c{i} STRING" for i in range(len(names) + 1))),
        {key: str(settings[key]) for key in ("sep", "quote", "escape")},
    )
    facts = [
        F.count_if(again[f"c{len(names)}"].isNotNull()).alias("long_rows"),
        F.count_if(~_is_row()).alias("blank_rows"),
        F.count_if(_is_row()).alias("rows"),
    ]
    for i, name in enumerate(names):
        text = F.when(_is_row(), field(name))
        facts.append(F.count(text).alias(f"filled{i}"))
        if infer:
            facts += [
                F.bool_and(F.when(text.isNotNull(), read_bigint(text).isNotNull())).alias(f"int{i}"),
                F.bool_and(F.when(text.isNotNull(), read_double(text).isNotNull())).alias(f"float{i}"),
                F.bool_and(only_digits(text)).alias(f"digits{i}"),
                F.bool_and(F.when(text.isNotNull(), F.lower(text).isin("true", "false"))).alias(f"bool{i}"),
            ]
    return facts


def _typed(name: str, i: int, facts) -> Column:
    text = field(name)
    if not facts["rows"]:
        return F.lit(None).alias(name)
    if not facts[f"filled{i}"]:
        return F.lit(None).cast("double").alias(name)
    if facts[f"int{i}"]:
        return read_bigint(text).alias(name)
    # Whole numbers beyond BIGINT would lose digits as DOUBLE, so they stay text.
    if facts[f"float{i}"] and not facts[f"digits{i}"]:
        return read_double(text).alias(name)
    if facts[f"bool{i}"]:
        return (F.lower(text) == "true").alias(name)
    return text
