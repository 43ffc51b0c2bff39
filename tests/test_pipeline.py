"""Runs over several blueprints: order, failures, dry runs, validation, audit."""

from __future__ import annotations

import pytest

import tablewright
from tablewright.errors import ConfigValidationError, FileGuardError, TransformError, WriteVerificationError
from tablewright.operators import joins, quality
from tablewright.sources import storage
from tablewright.sources.tables import read_table
from tablewright.spec import FileOptions
from tests import samples
from tests.samples import blueprint, config, direct, join, mapping, predicate
from tests.test_golden import written


@pytest.fixture
def folder(tmp_path):
    samples.write_inputs(tmp_path, employees=samples.EMPLOYEES, departments=samples.DEPARTMENTS)
    return tmp_path


def split_config(folder, **options):
    """One source, two targets; the second comes first in the list."""
    return config(
        folder,
        blueprint(
            "contact",
            "employees.csv",
            "emp",
            "employees_contact.csv",
            [direct("employee_id", "emp.id"), direct("email", "emp.email", default_value="unknown@example.com")],
            order=2,
        ),
        blueprint(
            "summary",
            "employees.csv",
            "emp",
            "employees_summary.csv",
            [direct("employee_id", "emp.id"), direct("full_name", "emp.full_name")],
            order=1,
        ),
        **options,
    )


def outputs(folder):
    output = folder / "output"
    return sorted(p.name for p in output.iterdir() if not p.name.startswith(".")) if output.exists() else []


@pytest.mark.parametrize("persist", [False, True])
def test_one_source_two_targets(spark, folder, persist):
    result = tablewright.run(spark, split_config(folder), persist_shared=persist)
    assert [r.blueprint_id for r in result.results] == ["summary", "contact"]
    assert written(folder / "output" / "employees_contact.csv")[1] == [
        ["1", "alice@example.com"],
        ["2", "bob@example.com"],
        ["3", "unknown@example.com"],
    ]
    table = result.table(spark).collect()
    assert [(row["target"], row["row_count"]) for row in table] == [
        ("employees_summary.csv", 3),
        ("employees_contact.csv", 3),
    ]
    assert all(row["bytes_written"] > 0 for row in table)


def test_join_pre_filter_is_not_a_where(spark, folder):
    settings = config(
        folder,
        blueprint(
            "bp",
            "employees.csv",
            "emp",
            "out.csv",
            [direct("id", "emp.id"), direct("department", "dept.name")],
            joins=[
                join(
                    "LEFT",
                    "departments.csv",
                    "dept",
                    [predicate("emp.department_id", "==", "dept.id", "column")],
                    pre_filters=[predicate("dept.name", "!=", "Sales")],
                )
            ],
        ),
    )
    result = tablewright.run(spark, settings)
    assert written(folder / "output" / "out.csv")[1] == [["1", "Engineering"], ["2", ""], ["3", "Marketing"]]
    audit = [
        (row["step"], row["rows_before"], row["rows_after"]) for row in result.audit(spark).orderBy("position").collect()
    ]
    assert audit == [
        ("pre_filters", None, 3),
        ("pre_filters dept", None, 2),
        ("join dept", 3, 3),
        ("mappings", 3, 3),
        ("post_filters", 3, 3),
    ]


def test_a_failure_stops_the_run_and_leaves_no_trace(spark, folder):
    settings = split_config(folder)
    settings["blueprints"][0]["mappings"].append(direct("bad", "emp.full_name", "int64"))
    with pytest.raises(TransformError) as caught:
        tablewright.run(spark, settings)
    error = caught.value
    assert (error.gate, error.column, error.blueprint_id, error.migration_id) == ("G4", "bad", "contact", "mig")
    # The blueprint before it was done by then, and stays.
    assert outputs(folder) == ["employees_summary.csv"]


@pytest.mark.parametrize("dry_run", [False, True])
def test_dropped_rows_still_count_at_the_gates(spark, folder, dry_run):
    settings = split_config(folder)
    settings["blueprints"] = settings["blueprints"][:1]
    settings["blueprints"][0]["mappings"] = [
        direct("employee_id", "emp.id", "int64"),
        direct("email", "emp.email", nullable=False),
    ]
    settings["blueprints"][0]["post_filters"] = [predicate("employee_id", "<", 3)]
    with pytest.raises(TransformError) as caught:
        tablewright.run(spark, settings, dry_run=dry_run)
    assert (caught.value.gate, caught.value.column) == ("G4", "email")
    assert outputs(folder) == []


def test_filters_may_leave_nothing(spark, folder):
    settings = split_config(folder)
    for one in settings["blueprints"]:
        one["pre_filters"] = [predicate("emp.id", ">", 100)]
    result = tablewright.run(spark, settings)
    assert [r.row_count for r in result.results] == [0, 0]
    settings["blueprints"][0]["mappings"][0]["is_nullable"] = False
    settings["connections"]["files"]["target_path"] = f"{folder}/second"
    with pytest.raises(TransformError) as caught:
        tablewright.run(spark, settings)
    assert caught.value.gate == "G3"


def test_an_empty_root_stops_the_run_but_an_empty_join_table_does_not(spark, tmp_path):
    header = samples.EMPLOYEES.splitlines()[0] + "\n"
    samples.write_inputs(tmp_path, employees=samples.EMPLOYEES, departments="id,name\n")
    result = tablewright.run(spark, samples.employees_config(tmp_path))
    assert [r.row_count for r in result.results] == [3, 3]
    samples.write_inputs(tmp_path / "b", employees=header, departments=samples.DEPARTMENTS)
    with pytest.raises(TransformError) as caught:
        tablewright.run(spark, samples.employees_config(tmp_path / "b"))
    assert (caught.value.gate, caught.value.phase) == ("G2", "extract")


def test_validate(spark, folder):
    found = tablewright.validate(spark, samples.employees_config(folder))
    assert (found.blueprints, found.required_sources, found.targets) == (
        2,
        ["departments.csv", "employees.csv"],
        ["employees_export.csv", "employees_with_department.csv"],
    )
    names = {"departments.csv", "employees.csv"}
    tablewright.validate(spark, samples.employees_config(folder), supplied=names)
    for supplied in ({"employees.csv"}, names | {"other.csv"}):
        with pytest.raises(FileGuardError) as caught:
            tablewright.validate(spark, samples.employees_config(folder), supplied=supplied)
        assert caught.value.gate == "G1"
    (folder / "input" / "departments.csv").unlink()
    with pytest.raises(FileGuardError):
        tablewright.validate(spark, samples.employees_config(folder))


def test_targets_must_be_empty(spark, folder):
    tablewright.run(spark, split_config(folder))
    with pytest.raises(FileGuardError) as caught:
        tablewright.run(spark, split_config(folder))
    assert caught.value.gate == "G1"


def test_two_blueprints_with_one_target(spark, folder):
    settings = split_config(folder)
    settings["blueprints"][0]["target"]["file_name"] = "employees_summary.csv"
    with pytest.raises(WriteVerificationError) as caught:
        tablewright.run(spark, settings)
    assert caught.value.gate == "G4"


def test_size_limit_and_format(spark, folder):
    with pytest.raises(ConfigValidationError):
        tablewright.validate(spark, split_config(folder, max_file_size_mb=-1))
    with pytest.raises(ConfigValidationError) as caught:
        tablewright.validate(spark, split_config(folder, format="XLSX"))
    assert caught.value.gate == "G0"


def test_sources_lie_in_their_own_connection(spark, folder):
    settings = samples.employees_config(folder)
    (folder / "elsewhere").mkdir()
    (folder / "input" / "departments.csv").rename(folder / "elsewhere" / "departments.csv")
    settings["connections"]["other"] = {
        "type": "LOCAL_FILE_DIRECTORY",
        "base_path": str(folder / "elsewhere"),
        "target_path": str(folder / "output"),
    }
    settings["blueprints"][1]["sources"]["joins"][0]["connection_ref"] = "other"
    assert [r.row_count for r in tablewright.run(spark, settings).results] == [3, 3]


def test_frames_instead_of_files(spark, tmp_path):
    people = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    settings = config(
        tmp_path,
        blueprint("bp", "people", "p", "out", [direct("id", "p.id", "int64"), direct("name", "p.name")]),
        format="PARQUET",
    )
    target = tablewright.transform(spark, settings, sources={"people": people})
    assert target.dtypes == [("id", "bigint"), ("name", "string")]
    tablewright.run(spark, settings, sources={"people": people})
    assert spark.read.parquet(str(tmp_path / "output" / "out")).count() == 2
    with pytest.raises(FileGuardError):
        tablewright.run(spark, settings, sources={"people": people, "other": people})


def test_errors_name_their_blueprint(spark, folder):
    settings = split_config(folder)
    settings["blueprints"][0]["mappings"].append(mapping("x", "EXPRESSION", "emp.nothing + 1"))
    with pytest.raises(TransformError) as caught:
        tablewright.transform(spark, settings, "contact")
    assert (caught.value.blueprint_id, caught.value.column) == ("contact", "emp__nothing")


def test_aggregates_in_post_filters_see_the_mapped_table(spark, folder):
    settings = split_config(folder)
    settings["blueprints"] = settings["blueprints"][:1]
    settings["blueprints"][0]["mappings"] = [direct("employee_id", "emp.id", "int64", nullable=False)]
    settings["blueprints"][0]["post_filters"] = [
        {"type": "expression", "value": "employee_id >= employee_id.mean()"},
        {"type": "expression", "value": "employee_id.rank() > 1"},
    ]
    result = tablewright.run(spark, settings)
    assert result.results[0].row_count == 1
    assert written(folder / "output" / "employees_contact.csv")[1] == [["3"]]


def test_columns_that_have_to_be_looked_through_first(spark, tmp_path):
    """Dates read from text and written as text, after a join that runs only once."""
    samples.write_inputs(tmp_path, sales_orders=samples.SALES_ORDERS, regions=samples.REGIONS)
    settings = config(
        tmp_path,
        blueprint(
            "bp",
            "sales_orders.csv",
            "ord",
            "out.csv",
            [
                direct("id", "ord.order_id", "int64", nullable=False),
                direct("ordered", "ord.order_date", "datetime64[ns]", nullable=False),
                direct("country", "reg.country"),
            ],
            joins=[join("INNER", "regions.csv", "reg", [predicate("ord.region_code", "==", "reg.region_code", "column")])],
            post_filters=[{"type": "expression", "value": "ordered.dt.month >= 2"}],
        ),
    )
    result = tablewright.run(spark, settings)
    assert written(tmp_path / "output" / "out.csv")[1] == [
        ["1002", "2024-02-01", "USA"],
        ["1003", "2024-02-10", "EU"],
        ["1004", "2024-03-01", "USA"],
        ["1005", "2024-03-15", "SG"],
    ]
    assert outputs(tmp_path) == ["out.csv"]
    audit = [(row["step"], row["rows_after"]) for row in result.audit(spark).orderBy("position").collect()]
    assert audit == [("pre_filters", 6), ("join reg", 5), ("mappings", 5), ("post_filters", 4)]


@pytest.mark.parametrize("kind", ["LEFT", "INNER", "RIGHT", "OUTER"])
def test_large_joins_count_the_same_rows(spark, folder, monkeypatch, kind):
    """Looking for hot and missing keys leaves the audit alone."""
    monkeypatch.setattr(joins, "_is_large", lambda frame: True)
    monkeypatch.setattr(joins, "ROWS_PER_PART", 1)
    settings = samples.employees_config(folder)
    settings["blueprints"] = settings["blueprints"][1:]
    only = settings["blueprints"][0]
    only["sources"]["joins"][0] |= {"join_type": kind, "pre_filters": [predicate("dept.name", "!=", "Sales")]}
    for one in only["mappings"]:
        one["is_nullable"] = True
    rows = 3 if kind in ("LEFT", "OUTER") else 2
    result = tablewright.run(spark, settings)
    assert result.results[0].row_count == rows
    audit = [(row["step"], row["rows_after"]) for row in result.audit(spark).orderBy("position").collect()]
    assert audit == [
        ("pre_filters", 3),
        ("pre_filters dept", 2),
        ("join dept", rows),
        ("mappings", rows),
        ("post_filters", rows),
    ]


@pytest.mark.parametrize("dry_run", [False, True])
@pytest.mark.parametrize("expression", ["emp.id * 9223372036854775807", "emp.full_name.astype('int64')"])
def test_values_an_expression_cannot_handle(spark, folder, expression, dry_run):
    settings = split_config(folder)
    settings["blueprints"] = settings["blueprints"][:1]
    settings["blueprints"][0]["mappings"].append(mapping("x", "EXPRESSION", expression))
    with pytest.raises(TransformError) as caught:
        tablewright.run(spark, settings, dry_run=dry_run)
    assert (caught.value.gate, caught.value.phase, caught.value.blueprint_id) == ("G2", "execution", "contact")
    assert outputs(folder) == []


@pytest.mark.parametrize(
    ("derivation", "failing"),
    [
        ({"transform_type": "EXPRESSION", "expression": "emp.full_name.astype('int64')"}, 3),
        ({"transform_type": "EXPRESSION", "expression": "(emp.id * 1000) ** 7"}, 3),
        ({"transform_type": "EXPRESSION", "expression": "2 ** (2 - emp.id)"}, 1),
        ({"transform_type": "EXPRESSION", "expression": "emp.full_name.astype('float64').max() + emp.id"}, 3),
        (
            {
                "transform_type": "CASE",
                "branches": [{"when": predicate("emp.id", "==", 99), "then": "emp.full_name.astype('int64')"}],
                "else": 1,
            },
            3,
        ),
    ],
)
def test_a_failing_derivation_that_nothing_uses_stops_the_run(spark, folder, derivation, failing):
    settings = config(
        folder,
        blueprint(
            "bp",
            "employees.csv",
            "emp",
            "out.csv",
            [direct("id", "emp.id")],
            derivations=[{"variable_name": "odd", **derivation}],
        ),
    )
    with pytest.raises(TransformError) as stopped:
        tablewright.run(spark, settings)
    assert stopped.value.gate == "G2"
    assert f"deriv__odd' failed in {failing} rows" in str(stopped.value)
    assert not (folder / "out.csv").exists()
    report = {row.target_column: row for row in tablewright.plan(spark, settings).gate_report().collect()}
    assert report["deriv__odd"].cast_failures == failing
    # Lazily and without gates, what fails is missing.
    assert tablewright.transform(spark, settings).columns == ["id"]


def test_a_failing_expression_of_a_filter_stops_the_run(spark, folder):
    settings = config(
        folder,
        blueprint(
            "bp",
            "employees.csv",
            "emp",
            "out.csv",
            [direct("id", "emp.id")],
            pre_filters=[{"type": "expression", "value": "emp__full_name.astype('int64') == 1"}],
        ),
    )
    with pytest.raises(TransformError):
        tablewright.run(spark, settings)


@pytest.mark.parametrize("format", ["CSV", "PARQUET"])
@pytest.mark.parametrize("order", ["in_place", "object store"])
def test_targets_are_published_without_moving_them(spark, folder, monkeypatch, format, order):
    """Rows are written where they stay; nobody reads them before the gates have passed."""
    options = {"format": "CSV"} | ({"publish": "in_place"} if order == "in_place" else {})
    if order == "object store":
        monkeypatch.setattr(storage, "OBJECT_STORES", ("file",))
    moves, seen = [], []
    monkeypatch.setattr(storage, "rename", lambda *paths: moves.append(paths))
    monkeypatch.setattr(storage, "concatenate", lambda *paths: moves.append(paths))
    settings = config(
        folder, blueprint("bp", "employees.csv", "emp", "out", [direct("id", "emp.id"), direct("name", "emp.full_name")]), **options
    )
    settings["connections"]["lake"] = {
        "type": "LOCAL_FILE_DIRECTORY", "base_path": str(folder), "target_path": str(folder / "output"), "file_options": {**options, "format": format},
    }
    settings["blueprints"][0]["target"]["connection_ref"] = "lake"
    target, judge = str(folder / "output" / "out"), quality.judge

    def looked(*args):
        with pytest.raises(FileGuardError, match="not complete"):
            read_table(spark, target, FileOptions(format=format))
        seen.append(storage.total_bytes(spark, target))
        judge(*args)

    monkeypatch.setattr(quality, "judge", looked)
    result = tablewright.run(spark, settings)
    assert result.results[0].row_count == 3 and moves == [] and seen and min(seen) > 0
    assert read_table(spark, target, FileOptions(format=format)).count() == 3
    with pytest.raises(FileGuardError):
        tablewright.run(spark, settings)

    # What a gate stops leaves nothing behind.
    monkeypatch.setattr(quality, "judge", judge)
    failing = dict(settings)
    failing["blueprints"] = [{**settings["blueprints"][0], "mappings": [direct("id", "emp.full_name", "int64")], "target": {"connection_ref": "lake", "file_name": "other"}}]
    with pytest.raises(TransformError):
        tablewright.run(spark, failing)
    assert not (folder / "output" / "other").exists()
