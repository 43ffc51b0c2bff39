"""Joins against brute force, including hot keys split over many parts."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tablewright.errors import TransformError
from tablewright.operators import joins
from tablewright.operators.joins import apply_join, find_keys, hot_keys
from tablewright.spec import ConditionGroup, Predicate

LEFT = [(1, "x", 10), (2, "y", 20), (3, None, 30), (4, None, 40), (5, "z", 50)]
RIGHT = [("x", 1), ("x", 2), (None, 3), ("q", 4)]


def key(left, right):
    return Predicate(left, "==", right, "column")


def literal(left, operator, right=None):
    return Predicate(left, operator, right, "literal")


@pytest.fixture(scope="module")
def tables(spark):
    left = spark.createDataFrame(LEFT, "a__id bigint, a__k string, a__n bigint")
    right = spark.createDataFrame(RIGHT, "b__k string, b__v bigint")
    return left, right


def brute(kind, left=LEFT, right=RIGHT):
    """Rows of a join on the left table's second and the right table's first column."""
    pairs = [(a, b) for a in left for b in right if a[1] == b[0]]
    rows = [a + b for a, b in pairs]
    if kind in ("LEFT", "OUTER"):
        rows += [a + (None,) * 2 for a in left if all(a[1] != b[0] for b in right)]
    if kind in ("RIGHT", "OUTER"):
        rows += [(None,) * 3 + b for b in right if all(a[1] != b[0] for a in left)]
    return Counter(rows)


def bag(frame):
    return Counter(tuple(row) for row in frame.collect())


@pytest.mark.parametrize("kind", ["LEFT", "INNER", "RIGHT", "OUTER", "left"])
def test_missing_keys_match(tables, kind):
    joined = apply_join(*tables, kind, [key("a.k", "b.k")])
    assert joined.columns == ["a__id", "a__k", "a__n", "b__k", "b__v"]
    assert bag(joined) == brute(kind.upper())


@pytest.mark.parametrize("kind", ["LEFT", "INNER", "RIGHT", "OUTER"])
@pytest.mark.parametrize("rows_per_part", [1, 2, 7])
def test_hot_keys_give_the_same_rows(spark, kind, rows_per_part):
    draw = random.Random(f"{kind}{rows_per_part}")
    names = ["hot", None, "warm", "a", "b", "c", "left only", "d"]
    weights = [8, 4, 3, 1, 1, 1, 1, 1]
    left = [(i, draw.choices(names, weights)[0], i % 3) for i in range(60)]
    right = [(draw.choices([*names[:-2], "right only"], weights[:-1])[0], i) for i in range(45)]
    # Copies are rows like any other.
    left += left[:10]
    joined = apply_join(
        spark.createDataFrame(left, "a__id bigint, a__k string, a__n bigint").repartition(3),
        spark.createDataFrame(right, "b__k string, b__v bigint").repartition(3),
        kind,
        [key("a.k", "b.k")],
        rows_per_part=rows_per_part,
    )
    assert joined.columns == ["a__id", "a__k", "a__n", "b__k", "b__v"]
    assert bag(joined) == brute(kind, left, right)


def test_hot_keys_are_counted_exactly(spark):
    rows = [("h", 1)] * 50 + [(None, 2)] * 30 + [(str(i), 3) for i in range(100)]
    frame = spark.createDataFrame(rows, "k string, v int").repartition(4)
    found = {row["key0"]: row["parts"] for row in hot_keys(frame, ["k"], 20).collect()}
    assert found == {"h": 3, None: 2}
    assert hot_keys(frame, ["k"], 50) is None
    assert hot_keys(frame.limit(0), ["k"], 1) is None


def test_what_leads_up_to_a_side_runs_once(spark, tmp_path, monkeypatch):
    """A chain of outer joins stores each result once; the sources are read for their keys and for the join."""
    monkeypatch.setattr(joins, "_is_large", lambda frame: True)
    for name, rows in (("a", 40), ("b", 30), ("c", 35), ("d", 20)):
        spark.range(rows).selectExpr(f"id % 11 AS {name}__k", f"id AS {name}__v", f"repeat('x', 9) AS {name}__wide").write.parquet(str(tmp_path / name))
    sides = {name: spark.read.parquet(str(tmp_path / name)) for name in "abcd"}
    passes = []
    original = joins._passing_by

    def noted(frame, names, action):
        passes.append((frame.columns, action is not joins._run))
        return original(frame, names, action)

    monkeypatch.setattr(joins, "_passing_by", noted)
    joined = sides["a"]
    for name in "bcd":
        joined = apply_join(joined, sides[name], "OUTER", [key("a.k", f"{name}.k")])
    stored = [columns for columns, kept in passes if kept]
    read = [columns for columns, kept in passes if not kept]
    # Of the files only the keys are read; of the joins two results are stored, each with the key.
    assert len(stored) == 2 and all("a__v" in columns for columns in stored)
    assert len(read) == 4 and all(len(columns) == 1 for columns in read)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
    frames = {name: frame.toPandas() for name, frame in sides.items()}
    brute_rows = frames["a"]
    for name in "bcd":
        brute_rows = brute_rows.merge(frames[name], how="outer", left_on="a__k", right_on=f"{name}__k")
    assert joined.count() == len(brute_rows)


def test_a_split_side_reads_no_more_columns_than_are_used(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(joins, "_is_large", lambda frame: True)
    spark.range(60).selectExpr("id % 3 AS a__k", "id AS a__v", "repeat('x', 9) AS a__wide").write.parquet(str(tmp_path / "a"))
    spark.range(40).selectExpr("id % 4 AS b__k", "id AS b__v", "repeat('y', 9) AS b__wide").write.parquet(str(tmp_path / "b"))
    a, b = (spark.read.parquet(str(tmp_path / name)) for name in "ab")
    joined = apply_join(a, b, "OUTER", [key("a.k", "b.k")], rows_per_part=5).select("a__v", "b__v")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a__k:bigint,a__v:bigint>" in plan and "ReadSchema: struct<b__k:bigint,b__v:bigint>" in plan
    assert "wide" not in plan
    plain = a.join(b, a["a__k"] == b["b__k"], "full").select("a__v", "b__v")
    assert bag(joined) == bag(plain)


def test_large_tables_are_split_and_null_free_keys_join_plainly(spark, tables, monkeypatch):
    monkeypatch.setattr(joins, "_is_large", lambda frame: True)
    monkeypatch.setattr(joins, "ROWS_PER_PART", 1)
    left, right = tables
    assert bag(apply_join(left, right, "OUTER", [key("a.k", "b.k")])) == brute("OUTER")
    inner = apply_join(left, right.where("b__k IS NOT NULL"), "INNER", [key("a.k", "b.k")])
    assert bag(inner) == brute("INNER", right=[row for row in RIGHT if row[0]])
    plan = inner._jdf.queryExecution().optimizedPlan().toString()
    assert "<=>" not in plan and "a__k" in plan
    assert bag(apply_join(left, right, "INNER", [key("a.k", "b.k")])) == brute("INNER")


def test_residual_conditions_filter_joined_rows(tables):
    joined = apply_join(*tables, "LEFT", [key("a.k", "b.k"), literal("b.v", ">", 1)])
    assert sorted(row["a__id"] for row in joined.collect()) == [1, 3, 4]
    group = ConditionGroup("OR", (literal("b.v", "IS_NULL"), literal("a.n", "<", 15)))
    joined = apply_join(*tables, "LEFT", [key("a.k", "b.k"), group])
    assert sorted(row["a__id"] for row in joined.collect()) == [1, 1, 2, 5]


def test_a_mixed_group_checks_its_keys_again(tables):
    """Its key equality is two-valued the second time, so missing keys no longer match."""
    group = ConditionGroup("AND", (key("a.k", "b.k"), literal("a.n", ">", 0)))
    joined = apply_join(*tables, "LEFT", [group])
    assert sorted((row["a__id"], row["b__v"]) for row in joined.collect()) == [(1, 1), (1, 2)]
    pure = ConditionGroup("AND", (key("a.k", "b.k"), ConditionGroup("AND", (key("a.k", "b.k"),))))
    assert bag(apply_join(*tables, "INNER", [pure])) == brute("INNER")


def test_keys_may_be_written_either_way_round(tables):
    assert bag(apply_join(*tables, "LEFT", [key("b.k", "a.k")])) == brute("LEFT")


def test_numbers_of_different_types_join(spark):
    left = spark.createDataFrame([(1,), (2,)], "a__k int")
    right = spark.createDataFrame([(2.0,), (float("nan"),)], "b__k double")
    assert bag(apply_join(left, right, "INNER", [key("a.k", "b.k")])) == {(2, 2.0): 1}


def test_errors(spark, tables):
    left, right = tables
    for conditions in (
        [literal("a.k", "==", "x")],
        [Predicate("a.k", "<", "b.k", "column")],
        [ConditionGroup("OR", (key("a.k", "b.k"), key("a.k", "b.k")))],
        [key("a.k", "a.id")],
        [key("a.n", "b.k")],
        [key("a.missing", "b.k")],
        [key("a.k", "c.k")],
    ):
        with pytest.raises(TransformError) as caught:
            apply_join(left, right, "LEFT", conditions)
        assert caught.value.gate == "G2"
    with pytest.raises(TransformError) as caught:
        find_keys(left, right, [key("a.missing", "b.k")])
    assert caught.value.column == "a__missing"
    with pytest.raises(TransformError):
        apply_join(left, right, "CROSS", [key("a.k", "b.k")])
