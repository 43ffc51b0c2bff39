"""Shared folders for intermediate tables, and names that clash with nothing."""

from __future__ import annotations

import atexit
import gc
import os
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources import storage


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The folder driver and executors share; one of our own only on a single machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tablewright-llm-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


def importable(spark: SparkSession) -> None:
    """Workers that share this file system import this package from where the driver has it.

    Batches of rows that go to workers are bounded by bytes where the session does not say
    how: texts are long, and workers of an executor share its memory.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "4m")
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors.

    What a returned DataFrame still reads stays until the program ends; ``drop`` removes
    a table earlier.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = storage.join_path(shared_folder(spark), f"llm-{uuid.uuid4().hex}")
        self._tables = 0
        atexit.register(self._remove, self.root)

    def folder(self, name: str) -> str:
        self._tables += 1
        return f"{self.root}/{self._tables:03d}-{name}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """The same rows, read back from a written table."""
        path = self.folder(name)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that ``keep`` has returned and nothing reads any more."""
        for frame in frames:
            for path in {file.rpartition("/")[0] for file in frame.inputFiles()}:
                storage.delete(self.spark, path)

    def release(self) -> None:
        """Let Spark delete shuffle files that no frame refers to any more.

        Listeners still hold the last query for a moment, hence the second time.
        """
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(1)

    def _remove(self, path: str) -> None:
        if self.spark.sparkContext._jsc is not None:
            storage.delete(self.spark, path)


def fresh_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores before it where the frame has such a column already."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")
