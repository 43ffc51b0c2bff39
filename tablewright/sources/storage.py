"""Files on whatever file system Spark reads: sizes, existence, renames, scratch space."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import FileGuardError


# Schemes of file systems over object stores.
OBJECT_STORES = ("s3", "s3a", "s3n", "gs", "oss", "cosn", "obs", "swift", "wasb", "wasbs")


def join_path(base: str, name: str) -> str:
    """``base/name``; an absolute name or URI stands for itself."""
    if name.startswith("/") or "://" in name:
        return name
    return base.rstrip("/") + "/" + name


def exists(spark: SparkSession, path: str) -> bool:
    system, location = _locate(spark, path)
    return system.exists(location)


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path with wildcards names anything."""
    system, location = _locate(spark, pattern)
    return bool(system.globStatus(location))


def is_directory(spark: SparkSession, path: str) -> bool:
    system, location = _locate(spark, path)
    return system.exists(location) and system.getFileStatus(location).isDirectory()


def total_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path, or below all that a path with wildcards names; 0 where nothing exists."""
    system, location = _locate(spark, path)
    if system.exists(location):
        return system.getContentSummary(location).getLength()
    return sum(system.getContentSummary(one.getPath()).getLength() for one in system.globStatus(location) or [])


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of the data files directly at or below a path."""
    system, location = _locate(spark, path)
    found = system.listStatus(location) if system.exists(location) else []
    return [
        (status.getPath().toString(), status.getLen())
        for status in found
        if not status.isDirectory() and not status.getPath().getName().startswith(("_", "."))
    ]


def rename(spark: SparkSession, source: str, target: str) -> bool:
    system, location = _locate(spark, source)
    return system.rename(location, _path(spark, target))


def renames_folders(spark: SparkSession, path: str) -> bool:
    """Whether the file system moves a folder in one step; object stores copy what is in it."""
    system, _ = _locate(spark, path)
    return system.getUri().getScheme() not in OBJECT_STORES


def touch(spark: SparkSession, path: str) -> None:
    """An empty file, and the folders above it."""
    system, location = _locate(spark, path)
    system.create(location, True).close()


def concatenate(spark: SparkSession, files: list[str], target: str, skip: int) -> None:
    """One file of the bytes of many; of all but the first without their first ``skip`` bytes.

    Bytes stream from file to file; nothing is parsed, and no more than a buffer is held.
    """
    system, location = _locate(spark, target)
    copy = spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes
    out = system.create(location)
    try:
        for index, file in enumerate(files):
            source = system.open(_path(spark, file))
            try:
                source.seek(skip if index else 0)
                copy(source, out, 1 << 20, False)
            finally:
                source.close()
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    system, location = _locate(spark, path)
    system.delete(location, True)


def make_parent(spark: SparkSession, path: str) -> None:
    system, location = _locate(spark, path)
    parent = location.getParent()
    if parent is not None:
        system.mkdirs(parent)


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder all executors share, below the checkpoint folder; gone when the program ends."""
    ensure_checkpoint_dir(spark)
    path = join_path(_shared_folder(spark), f"tablewright-{uuid.uuid4().hex}")
    atexit.register(_delete_if_running, spark, path)
    return path


def stored(frame: DataFrame) -> DataFrame:
    """The same rows, read from a table written to a scratch folder: lineage ends here.

    Unlike a checkpoint's files the table goes when the program ends, and only the columns
    that are asked for are read from it. Columns without a type hold nothing and are not written.
    """
    path = scratch_folder(frame.sparkSession)
    kept = [F.col("`" + x.name.replace("`", "``") + "`") for x in frame.schema if x.dataType != T.NullType()]
    written = frame.select(*kept)
    written.write.parquet(path)
    found = frame.sparkSession.read.schema(written.schema).parquet(path)
    if len(kept) == len(frame.columns):
        return found
    names = {x.lower() for x in found.columns}
    return found.select(*(F.col("`" + x.replace("`", "``") + "`") if x.lower() in names else F.lit(None).alias(x) for x in frame.columns))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; set one only where there is none and need be none."""
    context = spark.sparkContext
    if _shared_folder(spark) is None:
        if not context.master.startswith("local"):
            raise FileGuardError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="tablewright-")
        context.setCheckpointDir(own)
        atexit.register(shutil.rmtree, own, True)
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(_shared_folder(spark))


def _shared_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def _delete_if_running(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        delete(spark, path)


def _path(spark: SparkSession, path: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _locate(spark: SparkSession, path: str) -> tuple[Any, Any]:
    location = _path(spark, path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()), location
