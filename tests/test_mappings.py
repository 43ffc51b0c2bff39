"""Target columns: defaults, casts, text rendering, and the gates over them."""

from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.errors import TransformError
from tablewright.functions import looks
from tablewright.functions.text import double_text, finest_unit
from tablewright.operators import quality
from tablewright.operators.mappings import apply_mappings
from tablewright.spec import Mapping

NAN = float("nan")


def direct(target, source, cast_to="str", **more):
    return Mapping(target, "DIRECT", source, cast_to, **more)


def column(spark, values, kind, cast_to, **more):
    """The cast values, in order, after the gates were asked."""
    frame = spark.createDataFrame(list(enumerate(values)), f"t__id bigint, t__v {kind}").repartition(2)
    table = apply_mappings(frame, [direct("id", "t.id", "int64"), direct("v", "t.v", cast_to, **more)])
    quality.judge(table, table.staged.agg(*quality.gate_counts(table)).first().asDict())
    return [row["v"] for row in table.target().orderBy("id").collect()]


def fails(spark, values, kind, cast_to, gate="G4", **more):
    with pytest.raises(TransformError) as caught:
        column(spark, values, kind, cast_to, **more)
    assert (caught.value.gate, caught.value.column) == (gate, "v")


def test_str(spark):
    assert column(spark, [1, None, -3], "bigint", "str") == ["1", None, "-3"]
    assert column(spark, [True, False, None], "boolean", "str") == ["True", "False", None]
    assert column(spark, [255.0, NAN, 1e16, 1e-5, float("-inf")], "double", "str") == [
        "255.0", None, "1e+16", "1e-05", "-inf",
    ]
    assert column(spark, [" a ", "", None], "string", "str") == [" a ", "", None]


def test_doubles_print_as_python_prints_them(spark):
    draw = random.Random(7)
    values = [0.0, -0.0, 1.0, 1e7, 9999999.0, 9999999.5, 12345678.9, 1e15, 1e16, 123456789012345.6, 9007199254740993.0]
    values += [1e-3, 1e-4, 9.5e-5, 0.00012345, 1e-10, 1.5e-7, 1e22, 1.5e300, 5e-324, 1e100, -2.5e-8]
    values += [round(draw.uniform(-1e9, 1e9), draw.randrange(7)) for _ in range(2000)]
    values += [draw.uniform(1, 10) * 10.0 ** draw.randrange(-12, 16) for _ in range(2000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    rows = frame.select("v", double_text(F.col("v")).alias("text")).collect()
    wrong = [(row["v"], row["text"]) for row in rows if repr(row["v"]) != row["text"]]
    # Some Java versions give a few doubles one digit more than needed, subnormal ones above all.
    assert all(float(text) == value and len(text) - len(repr(value)) <= 2 for value, text in wrong)
    assert not [v for v, _ in wrong if 1e-300 < abs(v) < 1e16]


def test_doubles_print_without_decimals_and_patterns(spark):
    """Both cost many times as much as the digits themselves."""
    draw = random.Random(11)
    values = [draw.choice((-1, 1)) * round(draw.uniform(1, 10), draw.randrange(16)) * 10.0**p for p in range(-5, 15) for _ in range(100)]
    values += [4503599627370495.5, -2251799813685249.25, 9007199254740991.0, -9999999999999998.0, 21168.23 * 1e6, -1e-4, 7e-4]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", double_text(F.col("v")).alias("text"))
    assert [(row["v"], row["text"]) for row in frame.collect() if repr(row["v"]) != row["text"]] == []
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(" in plan and "decimal" not in plan and "regexp" not in plan


def test_the_finest_unit_is_found_without_printing(spark):
    seconds = "'2024-03-10 02:30:01'", "'1900-01-01 23:59:59'"
    units = {"'1883-11-18'": 0, **dict.fromkeys(seconds, 1), "'1900-01-01 00:00:00.25'": 2, "'1937-06-30 23:59:59.999999'": 3}
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        # A zone with offsets of 19 minutes and 32 seconds, and one with a gap at half past two.
        for zone in ("UTC", "Europe/Amsterdam", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for text, unit in units.items():
                frame = spark.sql(f"SELECT timestamp_ntz{text} AS t UNION ALL SELECT timestamp_ntz'2024-01-01' UNION ALL SELECT NULL")
                found = looks.ask(frame, [finest_unit(F.col("t"))])["answer0"]
                assert spark.range(1).select(found).first()[0] == unit, (zone, text)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    evidence = frame.select(finest_unit(F.col("t")).evidence)
    assert "as string" not in evidence._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize(
    ("moments", "expected"),
    [
        ([(2024, 1, 1), (2024, 1, 2), None], ["2024-01-01", "2024-01-02", None]),
        ([(2024, 1, 1), (2024, 1, 2, 10)], ["2024-01-01 00:00:00", "2024-01-02 10:00:00"]),
        (
            [(2024, 1, 1), (2024, 1, 2, 10, 0, 0, 500000)],
            ["2024-01-01 00:00:00.000", "2024-01-02 10:00:00.500"],
        ),
        ([(2024, 1, 1, 0, 0, 0, 123456)], ["2024-01-01 00:00:00.123456"]),
        ([None], [None]),
    ],
)
def test_timestamps_print_in_the_layout_the_column_needs(spark, moments, expected):
    values = [datetime.datetime(*m) if m else None for m in moments]
    assert column(spark, values, "timestamp_ntz", "str") == expected


def test_int64(spark):
    assert column(spark, ["2.0", " 3 ", "1e3", "-7", "+5"], "string", "int64") == [2, 3, 1000, -7, 5]
    assert column(spark, ["9007199254740993"], "string", "int64") == [9007199254740993]
    assert column(spark, [True, False], "boolean", "int64") == [1, 0]
    assert column(spark, [2.0, -0.0], "double", "int64") == [2, 0]
    for bad in (["1.5"], ["x"], [""], ["inf"], ["1d"], ["0x10"], ["1_000"], ["99999999999999999999"], ["1", None]):
        fails(spark, bad, "string", "int64")
    for bad in ([1.5], [NAN], [float("inf")], [1e19], [None, 1.0]):
        fails(spark, bad, "double", "int64")
    fails(spark, [1, None], "bigint", "int64")
    fails(spark, [datetime.datetime(2024, 1, 1)], "timestamp_ntz", "int64")


def test_float64(spark):
    assert column(spark, ["1e3", " .5", "5.", "inf", "-Infinity", "", None], "string", "float64") == [
        1000.0, 0.5, 5.0, float("inf"), float("-inf"), None, None,
    ]
    assert column(spark, [1, None], "bigint", "float64") == [1.0, None]
    assert column(spark, [True, None], "boolean", "float64") == [1.0, None]
    for bad in (["1,000"], ["x"], ["1d"], ["nan"], [" "], ["0x10"], ["1f"]):
        fails(spark, bad, "string", "float64")
    fails(spark, [datetime.datetime(2024, 1, 1)], "timestamp_ntz", "float64")


DATES = [
    ["2024-01-15", "2024-1-5"],
    ["2024/01/15"],
    ["2024.01.15"],
    ["20240115"],
    ["01/02/2024", "12/31/2023"],
    ["13/02/2024", "01/02/2024"],
    ["01-02-2024"],
    ["15.01.2024"],
    ["15 Jan 2024", "3 Feb 2024"],
    ["15-Jan-2024"],
    ["Jan 15, 2024"],
    ["January 15, 2024", "May 1, 2024"],
    ["2024-01"],
    ["2024"],
    ["2024-01-15T10:20:30"],
    ["2024-01-15 10:20"],
    ["2024-01-15 10:20:30.123"],
    ["2024-01-15 10:20:30.123456"],
    ["2024-01-15T10"],
    ["01/02/2024 10:20:30"],
    ["", "2024-01-01", None],
    ["NaT", "2024-01-01"],
]


@pytest.mark.parametrize("texts", DATES, ids=lambda texts: texts[0] or "blank")
def test_datetime_layouts(spark, texts):
    expected = pd.to_datetime(pd.Series(texts), errors="raise")
    assert column(spark, texts, "string", "datetime64[ns]") == [
        None if pd.isna(v) else v.to_pydatetime() for v in expected
    ]


@pytest.mark.parametrize(
    "texts",
    [
        ["hello"],
        ["2024-01-15", "01/02/2024"],
        ["2024-01-15", "2024-01-16 10:00:00"],
        ["2024-01-15 10:00:00", "2024-01-16 10:00:00.5"],
        ["2024-02-30"],
        ["2500-01-01"],
        ["2024-01-15 25:00"],
    ],
)
def test_datetime_failures(spark, texts):
    with pytest.raises(Exception):
        pd.to_datetime(pd.Series(texts), errors="raise")
    fails(spark, texts, "string", "datetime64[ns]")


def test_datetime_from_numbers_and_stated_layouts(spark):
    assert column(spark, [10**18, -5000, None], "bigint", "datetime64[ns]") == [
        datetime.datetime(2001, 9, 9, 1, 46, 40),
        datetime.datetime(1969, 12, 31, 23, 59, 59, 999995),
        None,
    ]
    stated = {"datetime_format": "dd|MM|yyyy HH.mm"}
    assert column(spark, ["05|02|2024 10.30", None, ""], "string", "datetime64[ns]", **stated) == [
        datetime.datetime(2024, 2, 5, 10, 30),
        None,
        None,
    ]
    fails(spark, ["2024-02-05"], "string", "datetime64[ns]", **stated)
    fails(spark, [True], "boolean", "datetime64[ns]")


def test_the_session_time_zone_has_no_say(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 02:30 on this day does not exist in New York.
        moment = datetime.datetime(2024, 3, 10, 2, 30)
        assert column(spark, ["2024-03-10 02:30"], "string", "datetime64[ns]") == [moment]
        stated = {"datetime_format": "yyyy-MM-dd HH:mm"}
        assert column(spark, ["2024-03-10 02:30"], "string", "datetime64[ns]", **stated) == [moment]
        assert column(spark, [moment], "timestamp_ntz", "str") == ["2024-03-10 02:30:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_defaults(spark):
    assert column(spark, [1, None], "bigint", "int64", default_value=0) == [1, 0]
    assert column(spark, [1.5, NAN, None], "double", "float64", default_value=7) == [1.5, 7.0, 7.0]
    assert column(spark, ["a", None], "string", "str", default_value="") == ["a", ""]
    assert column(spark, [1.0, None], "double", "str", default_value="z") == ["1.0", "z"]
    assert column(spark, [True, None], "boolean", "str", default_value=False) == ["True", "False"]
    assert column(spark, [1, None], "bigint", "str", default_value=None) == ["1", None]
    moment = datetime.datetime(2024, 1, 1)
    assert column(spark, [None, moment], "timestamp_ntz", "datetime64[ns]", default_value="2020-02-02") == [
        datetime.datetime(2020, 2, 2),
        moment,
    ]


def test_the_projection(spark):
    frame = spark.createDataFrame([(1, "a", 2.5)], "t__id bigint, t__s string, deriv__v double")
    table = apply_mappings(
        frame,
        [
            Mapping("v", "DERIVED", "deriv.v", "float64"),
            Mapping("e", "EXPRESSION", "t.id * 2 + deriv.v", "float64"),
            Mapping("c", "EXPRESSION", "'fixed'", "str"),
            Mapping("n", "EXPRESSION", "t.id.where(t.id < 0)", "str"),
            Mapping("b", "EXPRESSION", "t.id > 0", "str"),
            Mapping("r", "EXPRESSION", "t.id.rank()", "float64"),
        ],
    )
    assert [tuple(row) for row in table.target().collect()] == [(2.5, 4.5, "fixed", None, "True", 1.0)]
    assert table.columns == table.target().columns == ["v", "e", "c", "n", "b", "r"]


def test_mapping_errors(spark):
    frame = spark.createDataFrame([(1,)], "t__id bigint")
    for mappings in (
        [],
        [direct("x", "t.none")],
        [Mapping("x", "DERIVED", "deriv.none", "str")],
        [Mapping("x", "EXPRESSION", "t.none + 1", "str")],
        [Mapping("x", "OTHER", "t.id", "str")],
    ):
        with pytest.raises(TransformError) as caught:
            apply_mappings(frame, mappings)
        assert caught.value.gate == "G2"


# --- gates -------------------------------------------------------------------------


def test_required_columns(spark):
    fails(spark, ["a", None], "string", "str", gate="G4", is_nullable=False)
    fails(spark, [None, None], "string", "str", gate="G3", is_nullable=False)
    fails(spark, [], "string", "str", gate="G3", is_nullable=False)
    fails(spark, [NAN, 1.0], "double", "float64", gate="G4", is_nullable=False)
    # Text that means "no value" is there before the cast and gone after it.
    fails(spark, ["", ""], "string", "float64", gate="G4", is_nullable=False)
    assert column(spark, ["a"], "string", "str", is_nullable=False) == ["a"]
    assert column(spark, [], "string", "str") == []
    assert column(spark, [None], "string", "str", is_nullable=False, default_value="x") == ["x"]


def test_the_first_failing_mapping_is_reported(spark):
    frame = spark.createDataFrame([("x", None)], "t__a string, t__b string")
    table = apply_mappings(
        frame,
        [
            direct("fine", "t.b"),
            direct("number", "t.a", "float64", is_nullable=False),
            direct("empty", "t.b", is_nullable=False),
        ],
    )
    counts = table.staged.agg(*quality.gate_counts(table)).first().asDict()
    with pytest.raises(TransformError) as caught:
        quality.judge(table, counts)
    assert (caught.value.gate, caught.value.column) == ("G4", "number")
    assert "present0" not in counts and "failed2" not in counts
    report = {row["target_column"]: row for row in quality.gate_report(table).collect()}
    assert report["number"].asDict() == {
        "target_column": "number",
        "row_count": 1,
        "source_values": 1,
        "cast_failures": 1,
        "null_values": 1,
    }


def test_all_looks_at_whole_columns_share_one_pass(spark, tmp_path):
    """Timestamps written as text and read from text: the table is read for the looks and for the rows."""
    moments = spark.sql("SELECT id, '2024-01-0' || (id + 1) AS a, '3/' || (id + 1) || '/2024 10:00' AS b, "
                        "timestamp_ntz'2024-05-01' + make_dt_interval(cast(id AS int)) AS c, "
                        "timestamp_ntz'2024-05-01 10:00:00.5' AS d, cast(NULL AS string) AS e FROM range(5)")  # fmt: skip
    moments.write.parquet(str(tmp_path / "m"))
    table = spark.read.parquet(str(tmp_path / "m")).toDF("t__id", "t__a", "t__b", "t__c", "t__d", "t__e")
    wanted = [("a", "datetime64[ns]"), ("b", "datetime64[ns]"), ("c", "str"), ("d", "str"), ("e", "datetime64[ns]")]
    made = apply_mappings(table, [Mapping(x, "DIRECT", f"t.{x}", kind) for x, kind in wanted]).target()
    row = made.orderBy("a").first()
    assert (str(row.a), str(row.b), row.c, row.d, row.e) == (
        "2024-01-01 00:00:00", "2024-03-01 10:00:00", "2024-05-01", "2024-05-01 10:00:00.500", None,
    )
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2, plan
