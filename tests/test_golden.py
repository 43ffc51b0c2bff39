"""Whole runs over the sample files, compared with the expected files cell by cell."""

from __future__ import annotations

import csv
import io

import pytest

import tablewright
from tests import samples


def cells(text):
    header, *rows = csv.reader(io.StringIO(text))
    return header, sorted(rows)


def written(path):
    """The rows of a target folder or file, with the header every part repeats."""
    parts = [path] if path.is_file() else sorted(path.glob("part-*"))
    headers, rows = set(), []
    for part in parts:
        header, *body = csv.reader(io.StringIO(part.read_text(encoding="utf-8")))
        headers.add(tuple(header))
        rows += body
    assert len(headers) == 1
    return list(headers.pop()), sorted(rows)


@pytest.fixture
def employees(tmp_path):
    samples.write_inputs(tmp_path, employees=samples.EMPLOYEES, departments=samples.DEPARTMENTS)
    return tmp_path


@pytest.fixture
def sales(tmp_path):
    samples.write_inputs(
        tmp_path, sales_orders=samples.SALES_ORDERS, products=samples.PRODUCTS, regions=samples.REGIONS
    )
    return tmp_path


def test_two_blueprints(spark, employees):
    result = tablewright.run(spark, samples.employees_config(employees))
    assert [(r.blueprint_id, r.row_count) for r in result.results] == [("bp_direct", 3), ("bp_joined", 3)]
    assert all(r.bytes_written > 0 for r in result.results)
    output = employees / "output"
    assert written(output / "employees_export.csv") == cells(samples.EMPLOYEES_EXPORT)
    assert written(output / "employees_with_department.csv") == cells(samples.EMPLOYEES_WITH_DEPARTMENT)
    assert sorted(p.name for p in output.iterdir() if not p.name.startswith(".")) == [
        "employees_export.csv",
        "employees_with_department.csv",
    ]


def test_sales_sample(spark, sales):
    result = tablewright.run(spark, samples.sales_config(sales))
    assert written(sales / "output" / "sales_enriched_export.csv") == cells(samples.SALES_ENRICHED)
    audit = {row["step"]: (row["rows_before"], row["rows_after"]) for row in result.audit(spark).collect()}
    assert audit["pre_filters"][1] == 4
    assert audit["join prod"] == (4, 4)
    assert audit["join reg"] == (4, 4)
    assert audit["mappings"] == (4, 4)
    assert audit["post_filters"] == (4, 4)


def test_single_file(spark, sales):
    tablewright.run(spark, samples.sales_config(sales, single_file=True))
    path = sales / "output" / "sales_enriched_export.csv"
    assert path.is_file()
    assert written(path) == cells(samples.SALES_ENRICHED)
    assert [p.name for p in path.parent.iterdir() if not p.name.startswith(".")] == [path.name]


def test_dry_run_writes_nothing(spark, sales):
    result = tablewright.run(spark, samples.sales_config(sales), dry_run=True)
    assert [(r.row_count, r.bytes_written) for r in result.results] == [(4, 0)]
    assert not (sales / "output").exists()
