"""Predicates and filters on literal rows, missing values above all."""

from __future__ import annotations

import datetime
import random
import re

import pytest

from tablewright.errors import ConfigValidationError, TransformError
from tablewright.functions.values import as_value
from tablewright.operators.conditions import condition_mask, normalize_operator
from tablewright.operators.filters import apply_filters
from tablewright.spec import ConditionGroup, ExpressionFilter, Predicate

NAN = float("nan")


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            (1, "ACTIVE", 10, "Alice", 10, "Eng", 1.5, True),
            (2, "INACTIVE", 20, "Bob", 20, "HR", NAN, False),
            (3, "ACTIVE", 10, "Carol", 10, "Eng", None, None),
            (4, None, 30, "Da\nve", 40, "Finance", float("inf"), True),
        ],
        "emp__id bigint, emp__status string, emp__department_id bigint, emp__name string, "
        "dept__id bigint, dept__name string, emp__score double, emp__flag boolean",
    )


def ids(frame):
    return sorted(row["emp__id"] for row in frame.collect())


def literal(left, operator, right=None):
    return Predicate(left, operator, right, "literal")


def column(left, operator, right):
    return Predicate(left, operator, right, "column")


def kept(people, *conditions):
    return ids(apply_filters(people, conditions))


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        (literal("emp.status", "==", "ACTIVE"), [1, 3]),
        (literal("emp.status", "!=", "ACTIVE"), [2, 4]),
        (literal("emp.id", "<", 3), [1, 2]),
        (literal("emp.id", "<=", 3), [1, 2, 3]),
        (literal("emp.id", ">", 2.5), [3, 4]),
        (literal("emp.id", ">=", 4.0), [4]),
        (literal("emp.status", ">", "B"), [2]),
        (column("emp.department_id", "==", "dept.id"), [1, 2, 3]),
        (column("emp.department_id", "!=", "dept.id"), [4]),
        (column("emp.department_id", "<", "dept.id"), [4]),
        (literal("emp.status", "IN", ["ACTIVE", "INACTIVE"]), [1, 2, 3]),
        (literal("emp.status", "NOT_IN", ["ACTIVE"]), [2, 4]),
        (literal("emp.status", "IN", ["INACTIVE", None]), [2, 4]),
        (literal("emp.status", "NOT IN", ["INACTIVE", None]), [1, 3]),
        (literal("emp.id", "IN", []), []),
        (literal("emp.id", "NOT_IN", []), [1, 2, 3, 4]),
        (literal("emp.name", "LIKE", "C%"), [3]),
        (literal("emp.name", "LIKE", "_o_"), [2]),
        (literal("emp.name", "LIKE", "Da%ve"), []),
        (literal("emp.status", "NOT LIKE", "ACT%"), [2, 4]),
        (literal("emp.id", "LIKE", "3"), [3]),
        (literal("emp.score", "LIKE", "1.%"), [1]),
        (literal("emp.flag", "LIKE", "T%"), [1, 4]),
        (literal("emp.status", "IS_NULL"), [4]),
        (literal("emp.status", "IS NOT NULL"), [1, 2, 3]),
        (literal("emp.score", "IS_NULL"), [2, 3]),
        (literal("emp.score", "IS_NOT_NULL"), [1, 4]),
        (literal("emp.score", ">", 0), [1, 4]),
        (literal("emp.score", "<", 2), [1]),
        (literal("emp.score", "!=", 1.5), [2, 3, 4]),
        (column("emp.score", "==", "emp.score"), [1, 4]),
        (column("emp.score", "!=", "emp.score"), [2, 3]),
        (column("emp.score", ">=", "emp.score"), [1, 4]),
        (literal("emp.score", "IN", [1.5, None]), [1, 2, 3]),
        (literal("emp.score", "NOT_IN", [1.5]), [2, 3, 4]),
        # Families do not mix.
        (literal("emp.id", "==", "1"), []),
        (literal("emp.id", "!=", "1"), [1, 2, 3, 4]),
        (literal("emp.id", "IN", ["1", 2]), [2]),
        (literal("emp.flag", "==", 1), [1, 4]),
        (literal("emp.flag", "==", False), [2]),
        (literal("emp.id", "==", True), [1]),
    ],
)
def test_predicates(people, condition, expected):
    assert kept(people, condition) == expected


def test_groups_nest(people):
    condition = ConditionGroup(
        "OR",
        (
            literal("emp.name", "==", "Bob"),
            ConditionGroup("AND", (literal("emp.status", "==", "ACTIVE"), literal("emp.department_id", "==", 10))),
        ),
    )
    assert kept(people, condition) == [1, 2, 3]


def test_entries_hold_together(people):
    assert kept(people, literal("emp.status", "==", "ACTIVE"), literal("emp.id", ">", 1)) == [3]
    assert kept(people) == [1, 2, 3, 4]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("emp__id > 2", [3, 4]),
        ("emp.id > 2 and emp.status != 'ACTIVE'", [4]),
        ("not (emp.score > 0)", [2, 3]),
        ("~(emp.status == 'ACTIVE')", [2, 4]),
        ("emp.flag", [1, 4]),
        ("not emp.flag", [2, 3]),
        ("emp.flag.fillna(True)", [1, 3, 4]),
        ("emp.id > emp.id.mean()", [3, 4]),
        ("emp.department_id.rank() <= 2", [1, 3]),
        ("emp.name.str.contains('^[AB]')", [1, 2]),
        ("`emp__id` == 1 or `emp.id` == 2", [1, 2]),
        ("True", [1, 2, 3, 4]),
        ("1 > 2", []),
    ],
)
def test_expression_filters(people, text, expected):
    frame = apply_filters(people, [ExpressionFilter(text)])
    assert ids(frame) == expected
    assert frame.columns == people.columns


def test_a_mask_never_answers_unknown(people):
    for condition in (
        literal("emp.status", "==", "ACTIVE"),
        literal("emp.score", ">", 0),
        literal("emp.status", "LIKE", "A%"),
        literal("emp.score", "IN", [1.5]),
    ):
        mask = condition_mask(people, condition)
        rows = people.select(
            as_value(mask).column.alias("holds"), as_value(~mask).column.alias("fails")
        ).collect()
        assert all(row["holds"] is not row["fails"] for row in rows)


COLUMNS = {"id": "n", "department_id": "n", "score": "n", "status": "t", "name": "t"}


def random_condition(draw, depth):
    """A condition and what it means for a row, in plain Python."""
    if depth and draw.random() < 0.6:
        logic, size = draw.choice(["AND", "OR"]), draw.randrange(1, 4)
        parts = [random_condition(draw, depth - 1) for _ in range(size)]
        test = all if logic == "AND" else any
        return (
            ConditionGroup(logic, tuple(part for part, _ in parts)),
            lambda row: test(meaning(row) for _, meaning in parts),
        )
    name = draw.choice(sorted(COLUMNS))
    numeric = COLUMNS[name] == "n"
    value = draw.choice([1, 2, 3, 10, 20, 1.5] if numeric else ["ACTIVE", "Bob", "Carol", "B", "Z"])
    reference = f"emp.{name}"

    def cell(row):
        found = row[f"emp__{name}"]
        return None if found is None or found != found else found

    kind = draw.randrange(4)
    if kind == 0:
        operator = draw.choice(["==", "!=", "<", "<=", ">", ">="])
        compare = {
            "==": lambda a: a == value,
            "<": lambda a: a < value,
            "<=": lambda a: a <= value,
            ">": lambda a: a > value,
            ">=": lambda a: a >= value,
        }
        if operator == "!=":
            return literal(reference, operator, value), lambda row: cell(row) is None or cell(row) != value
        return literal(reference, operator, value), lambda row: cell(row) is not None and compare[operator](cell(row))
    if kind == 1:
        options = [value, draw.choice([None, 2, "ACTIVE"])]
        wanted = [option for option in options if option is None or isinstance(option, str) != numeric]
        if draw.random() < 0.5:
            return literal(reference, "IN", options), lambda row: cell(row) in wanted
        return literal(reference, "NOT_IN", options), lambda row: cell(row) not in wanted
    if kind == 2:
        if draw.random() < 0.5:
            return literal(reference, "IS_NULL"), lambda row: cell(row) is None
        return literal(reference, "IS_NOT_NULL"), lambda row: cell(row) is not None
    pattern = draw.choice(["%o%", "A%", "_", "1%", "%0"])
    expression = "".join({"%": ".*", "_": "."}.get(c, c) for c in pattern)

    def like(row):
        return cell(row) is not None and re.match(f"^{expression}$", str(cell(row))) is not None

    if draw.random() < 0.5:
        return literal(reference, "LIKE", pattern), like
    return literal(reference, "NOT_LIKE", pattern), lambda row: not like(row)


@pytest.mark.parametrize("seed", range(3))
def test_random_conditions(people, seed):
    draw = random.Random(seed)
    cases = [random_condition(draw, 3) for _ in range(25)]
    columns = []
    for i, (condition, _) in enumerate(cases):
        mask = condition_mask(people, condition)
        columns += [as_value(mask).column.alias(f"holds{i}"), as_value(~mask).column.alias(f"fails{i}")]
    for row in people.select("*", *columns).collect():
        for i, (condition, meaning) in enumerate(cases):
            expected = meaning(row.asDict())
            assert (row[f"holds{i}"], row[f"fails{i}"]) == (expected, not expected), condition


def test_timestamps_compare_with_text_literals(spark):
    frame = spark.createDataFrame(
        [(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 6, 1, 12)), (3, None)],
        "emp__id bigint, emp__at timestamp_ntz",
    )
    assert ids(apply_filters(frame, [literal("emp.at", ">", "2024-01-01")])) == [2]
    assert ids(apply_filters(frame, [literal("emp.at", "IN", ["2024-06-01 12:00:00"])])) == [2]
    assert ids(apply_filters(frame, [literal("emp.at", "==", "nonsense")])) == []
    with pytest.raises(TransformError):
        apply_filters(frame, [literal("emp.at", ">", "nonsense")])


@pytest.mark.parametrize(
    ("spelling", "canonical"),
    [
        ("=", "=="),
        (" eq ", "=="),
        ("<>", "!="),
        ("ne", "!="),
        ("lt", "<"),
        ("LE", "<="),
        ("gt", ">"),
        ("GE", ">="),
        ("not in", "NOT_IN"),
        ("is null", "IS_NULL"),
        ("Is Not Null", "IS_NOT_NULL"),
        ("NOT LIKE", "NOT_LIKE"),
    ],
)
def test_operator_spellings(spelling, canonical):
    assert normalize_operator(spelling) == canonical


def test_errors(people):
    with pytest.raises(ConfigValidationError):
        normalize_operator("~=")
    with pytest.raises(TransformError) as caught:
        apply_filters(people, [literal("emp.missing", "==", "x")])
    assert (caught.value.gate, caught.value.column) == ("G2", "emp__missing")
    for bad in (
        literal("emp.id", "<", "3"),
        column("emp.id", "<", "emp.name"),
        literal("emp.id", "IN", 3),
        column("emp.id", "IN", "emp.id"),
        column("emp.name", "LIKE", "emp.name"),
        literal("emp.id", "=="),
    ):
        with pytest.raises(TransformError):
            apply_filters(people, [bad])


def test_conditions_reach_the_file_scan(spark, tmp_path, people):
    people.write.parquet(str(tmp_path / "people"))
    stored = spark.read.parquet(str(tmp_path / "people"))
    filtered = apply_filters(
        stored, [literal("emp.status", "!=", "ACTIVE"), literal("emp.score", ">", 1), literal("emp.name", "LIKE", "Al%")]
    ).select("emp__id")
    plan = filtered._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    for part in ("IsNull(emp__status)", "GreaterThan(emp__score,1.0)", "StringStartsWith(emp__name,Al)"):
        assert part in pushed
    assert "ReadSchema: struct<emp__id:bigint,emp__status:string,emp__name:string,emp__score:double>" in pushed
