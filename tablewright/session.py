"""A session with the settings this library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution on, UTC, exact column names, no call-site capture per column.

    Generated methods beyond 8000 bytes are split instead: the JVM would only interpret
    them, which wide mappings with many casts run into. Further settings are added to
    these. On a cluster, leave ``master`` to spark-submit; partition counts and memory
    are the cluster's business.
    """
    builder = (
        SparkSession.builder.appName("tablewright")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.caseSensitive", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
