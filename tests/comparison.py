"""Comparing a Spark result with DuckDB's answer to the same question."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connect(folder):
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return database


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
        return ("date", value.isoformat())
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple((type(row[i]).__name__, plain(row[i])) for i in order) for row in rows)


def differences(frame, database, sql):
    """What the two results disagree about; empty if nothing."""
    answer = database.execute(sql)
    columns = [column[0] for column in answer.description]
    if sorted(columns) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} against {sorted(columns)}"]
    expected, found = bag(columns, answer.fetchall()), bag(frame.columns, frame.collect())
    lost, extra = expected - found, found - expected
    report = [f"{sum(found.values())} rows against {sum(expected.values())}"] if lost or extra else []
    report += [f"missing {row}" for row in list(lost)[:3]] + [f"unexpected {row}" for row in list(extra)[:3]]
    return report
