"""Results that must not depend on sizes: of CSV files, of exponents, of the number of hot keys."""

from __future__ import annotations

import io
import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import tablewright
from tablewright.operators import joins
from tablewright.sources.tables import needs_multi_line, read_table
from tablewright.spec import FileOptions, Predicate


def read_at(spark, path, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        return [tuple(row) for row in read_table(spark, str(path), FileOptions()).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('id,note,text,more\n1,5" pipe,"a\nb",6" y\n2,x,y,z\n', [(1, '5" pipe', "a\nb", '6" y'), (2, "x", "y", "z")]),
        ("id,text\n1,a\rb\n2,c\n", [("1", "a"), ("b", None), ("2", "c")]),
        ('a,b\n"x ""y"", z",1\n"p,""q""",2\n', [('x "y", z', 1), ('p,"q"', 2)]),
    ],
)
def test_rows_do_not_depend_on_the_split_size(spark, tmp_path, text, expected):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode())
    for split in ("7", "24", "128m"):
        assert read_at(spark, path, split) == expected


@pytest.mark.parametrize("seed", range(6))
def test_random_tables_against_pandas(spark, tmp_path, seed):
    pick = random.Random(seed)
    breaks = seed % 2 == 0

    def cell():
        text = "".join(pick.choice(["a", "b", ",", '"', " ", "7", *(["\n"] if breaks else [])]) for _ in range(pick.randint(1, 6))) + "x"
        quoted = any(x in text for x in ',\n"') and (text[0] == '"' or pick.random() < 0.7 or "," in text or "\n" in text)
        return '"' + text.replace('"', '""') + '"' if quoted else text

    text = "k,v,w\n" + "".join(f"{cell()},{cell()},{cell()}\n" for _ in range(40))
    path = tmp_path / "t.csv"
    path.write_text(text, newline="")
    wanted = sorted(map(tuple, pd.read_csv(io.StringIO(text)).itertuples(index=False)))
    for split in ("64", "300", "128m"):
        assert sorted(read_at(spark, path, split)) == wanted
    assert needs_multi_line(spark, str(path), FileOptions()) == any("\n" in x for row in wanted for x in row)


@pytest.mark.parametrize("multi_line", ["auto", "always"])
def test_lines_of_white_space_are_no_rows(spark, tmp_path, multi_line):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text("a,b,c\n1,2,3\n   \n\n4,5,6\n")
    options = {"format": "CSV", "multi_line": multi_line}
    frame = read_table(spark, str(tmp_path / "in" / "t.csv"), FileOptions(multi_line=multi_line))
    assert frame.count() == 2 and not frame.isEmpty()
    assert frame.select(F.lit(1)).collect() == [(1,), (1,)]
    mapping = {"target_column": "a", "source_type": "DIRECT", "source_value": "t.a", "cast_to": "str", "is_nullable": False}
    config = {
        "migration_id": "m", "client_id": "c", "version": "1",
        "connections": {"x": {"type": "LOCAL_FILE_DIRECTORY", "base_path": str(tmp_path / "in"), "target_path": str(tmp_path / "out"), "file_options": options}},
        "blueprints": [{
            "sequence_order": 1, "blueprint_id": "b",
            "sources": {"root_table": {"connection_ref": "x", "file_name": "t.csv", "alias": "t"}, "joins": []},
            "pre_filters": [], "derivations": [], "mappings": [mapping], "post_filters": [],
            "target": {"connection_ref": "x", "file_name": "o.csv"},
        }],
    }
    result = tablewright.run(spark, config)
    assert [row.row_count for row in result.table(spark).collect()] == [2]


@pytest.mark.parametrize("exponent", [0, 1, 2, 7, 8, 9, 12, 20])
def test_whole_powers_are_exact(spark, exponent):
    from tablewright.functions.expressions import evaluate

    bases = [-7, -2, -1, 0, 1, 2, 3, 7]
    frame = spark.createDataFrame([(x, exponent) for x in bases], "t__x long, t__n long")
    for text in (f"t.x ** {exponent}", "t.x ** t.n"):
        out, value = evaluate(frame, text, phase="test")
        assert [row[0] for row in out.select(value.column).collect()] == [x**exponent for x in bases]


@pytest.mark.parametrize(("base", "exponent"), [(97, 9), (3, 35), (-7, 21), (-2, 63), (2, 62), (-1, 10**6 + 1), (1, 400), (0, 99)])
def test_large_powers_are_exact(spark, base, exponent):
    from tablewright.functions.expressions import evaluate

    frame = spark.createDataFrame([(base, exponent)], "t__x long, t__n long")
    for text in (f"t.x ** {exponent}", "t.x ** t.n"):
        out, value = evaluate(frame, text, phase="test")
        assert out.select(value.column).first()[0] == base**exponent


def test_powers_that_do_not_fit_are_errors(spark):
    from tablewright.functions.expressions import evaluate

    frame = spark.createDataFrame([(3, 41), (2, 64)], "t__x long, t__n long")
    for text in ("t.x ** 64", "t.x ** t.n"):
        out, value = evaluate(frame, text, phase="test")
        with pytest.raises(Exception, match="overflow|OVERFLOW|fit"):
            out.select(value.column).collect()


@pytest.mark.parametrize(
    ("text", "number"),
    [
        ("1e-20", None), ("0.0000000000000000000001", None), ("1.5", None), ("12.50e1", 125), ("1.0", 1), ("120e-1", 12),
        ("1e400", None), ("0e-400", 0), ("-0.0", 0), ("9223372036854775807.0", 9223372036854775807), ("1e19", None), (".5e1", 5),
        ("1.000000000000000000000000000000", 1),
    ],
)
def test_whole_numbers_are_told_by_their_digits(spark, text, number):
    from tablewright.functions.casts import _whole_number

    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(_whole_number(F.col("t"))).first()[0] == number


def test_every_hot_key_is_split(spark):
    frame = spark.range(9_000).selectExpr("id % 1500 AS k", "id AS v")
    assert joins.hot_keys(frame, ["k"], 5).count() == 1500
    left = spark.range(9_000).selectExpr("id % 1500 AS l__k", "id AS l__v")
    right = spark.range(3_000).selectExpr("id % 1600 AS r__k", "id AS r__v")
    key = [Predicate("l.k", "==", "r.k", "column")]
    split = joins.apply_join(left, right, "OUTER", key, rows_per_part=2)
    plain = left.join(right, F.col("l__k") == F.col("r__k"), "full")
    assert split.exceptAll(plain).isEmpty() and plain.exceptAll(split).isEmpty()


def test_a_single_file_is_the_parts_one_behind_the_other(spark, tmp_path):
    from tablewright.sources import sinks

    frame = spark.range(1_000).selectExpr("id", "concat('x\n', id) AS s").repartition(7)
    chosen = FileOptions(single_file=True)
    sinks.write_table(frame, str(tmp_path / "staged"), chosen)
    sinks.publish(spark, str(tmp_path / "staged"), str(tmp_path / "out.csv"), chosen, ["id", "s"])
    found = pd.read_csv(tmp_path / "out.csv")
    assert sorted(found["id"]) == list(range(1_000)) and set(found["s"]) == {f"x\n{k}" for k in range(1_000)}
    assert sorted(x.name for x in tmp_path.iterdir() if not x.name.startswith(".")) == ["out.csv"]


def test_decimals_keep_their_digits_or_are_refused(spark):
    from tablewright.errors import FileGuardError
    from tablewright.sources.tables import plain_types

    frame = spark.sql("SELECT CAST(900719925474099301 AS DECIMAL(18,0)) a, CAST(1.25 AS DECIMAL(9,2)) b, CAST(7 AS DECIMAL(5,0)) c")
    assert plain_types(frame).dtypes == [("a", "bigint"), ("b", "double"), ("c", "double")]
    assert plain_types(frame).first()[0] == 900719925474099301
    for kind in ("DECIMAL(20,0)", "DECIMAL(18,2)"):
        with pytest.raises(FileGuardError):
            plain_types(spark.sql(f"SELECT CAST(1 AS {kind}) a"))


def test_quantiles_of_a_column_share_its_sketch(spark, monkeypatch):
    from tablewright.functions import aggregates
    from tablewright.functions.expressions import evaluate

    made = []
    original = aggregates.Sketched
    monkeypatch.setattr(aggregates, "Sketched", lambda *a: made.append(1) or original(*a))
    frame = spark.range(101).selectExpr("id AS t__x")
    out, value = evaluate(frame, "t.x.median() + t.x.quantile(0.25) + t.x.quantile(0.9)", phase="test")
    assert out.select(value.column).first()[0] == 50 + 25 + 90 and len(made) == 1


@pytest.mark.parametrize("counted", [20_000, 40])
@pytest.mark.parametrize("shape", ["even", "few values", "heavy ends", "heavy middle", "one", "two", "equal", "stored"])
def test_quantiles_are_exact(spark, tmp_path, monkeypatch, shape, counted):
    """However many passes narrow the bracket, and where one value has most of the rows."""
    from tablewright.functions import aggregates
    from tablewright.functions.values import FLOAT, Value

    monkeypatch.setattr(aggregates, "COUNTED", counted)
    rows = {
        "even": "SELECT cast(xxhash64(id) % 100003 AS double) / 7 AS v FROM range(30000)",
        "few values": "SELECT cast(id % 5 AS double) AS v FROM range(20000)",
        "heavy ends": "SELECT CASE WHEN id < 9000 THEN 0D WHEN id < 18020 THEN 2D ELSE 1 / id END AS v FROM range(18060)",
        "heavy middle": "SELECT CASE WHEN id % 3 = 0 THEN 0.5D ELSE rand(3) END AS v FROM range(20000)",
        "one": "SELECT 3.5D AS v",
        "two": "SELECT cast(id AS double) AS v FROM range(2)",
        "equal": "SELECT 7D AS v FROM range(5000)",
        "stored": "SELECT sum(cast(id AS double)) AS v FROM range(9000) GROUP BY id % 3000",
    }[shape]
    spark.sql(rows).write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    expected = frame.toPandas()["v"]
    if shape == "stored":
        frame = frame.groupBy("v").count().select("v")
        expected = pd.Series(expected.unique())
    for probability in (0, 0.2, 0.5, 0.9, 1):
        value = aggregates._quantile(frame, Value(F.col("v"), FLOAT), probability)
        found = spark.range(1).select(value.column).first()[0]
        assert math.isclose(found, expected.quantile(probability), rel_tol=1e-12)
    empty = aggregates._quantile(frame.where("v IS NULL"), Value(F.col("v"), FLOAT), 0.5)
    assert spark.range(1).select(empty.column).first()[0] is None
