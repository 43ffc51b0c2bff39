"""Written files, compared with what pandas writes for the same table."""

from __future__ import annotations

import datetime
import io

import pandas as pd
import pytest

from tablewright.errors import FileGuardError, WriteVerificationError
from tablewright.sources import sinks
from tablewright.spec import FileOptions

ROWS = [
    (1, 255.0, "plain", datetime.datetime(2024, 1, 15)),
    (2, 1e16, 'quo"te', datetime.datetime(2024, 1, 16)),
    (3, None, "semi;colon, comma", None),
    (None, 0.1, "two\nlines", datetime.datetime(2024, 1, 17)),
    (5, -1e-7, "", None),
    (6, 10000000.0, None, None),
    (7, 1.5, " kept ", None),
    (8, float("inf"), "back\\slash", None),
]
SCHEMA = "i bigint, f double, s string, t timestamp_ntz"


def lines(path):
    return sorted("".join(p.read_text(encoding="utf-8") for p in sorted(path.glob("part-*"))).splitlines())


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize(
    "options",
    [{}, {"delimiter": ";"}, {"quote_char": "'"}, {"header_row": False}, {"encoding": "utf-16"}],
    ids=str,
)
def test_against_pandas(table, tmp_path, options):
    chosen = FileOptions(**options)
    sinks.write_table(table.coalesce(1), str(tmp_path / "out"), chosen)
    expected = io.StringIO()
    frame = pd.DataFrame(ROWS, columns=["i", "f", "s", "t"])
    frame["i"] = frame["i"].astype("Int64")
    frame.to_csv(
        expected, index=False, sep=chosen.delimiter, quotechar=chosen.quote_char, header=chosen.header_row
    )
    text = "".join(p.read_bytes().decode(chosen.encoding) for p in (tmp_path / "out").glob("part-*"))
    assert text == expected.getvalue()


def test_one_column(spark, tmp_path):
    frame = spark.createDataFrame([("a",), (None,), ("",)], "only string")
    sinks.write_table(frame.coalesce(1), str(tmp_path / "out"), FileOptions())
    assert lines(tmp_path / "out") == ['""', '""', "a", "only"]
    assert sinks.count_written(spark, str(tmp_path / "out"), FileOptions(), ["only"]) == 3


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("options", [{}, {"header_row": False}, {"format": "PARQUET"}], ids=str)
def test_publish_and_verify(spark, table, tmp_path, options, single):
    chosen = FileOptions(**options, single_file=single)
    target, staged = tmp_path / "target", sinks.staging_path(str(tmp_path / "target"))
    target.write_text("")
    sinks.write_table(table.repartition(3), staged, chosen)
    size = sinks.publish(spark, staged, str(target), chosen, table.columns)
    assert size > 0 and target.is_file() == single
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["target"]
    sinks.verify(spark, str(target), chosen, table.columns, len(ROWS))
    with pytest.raises(WriteVerificationError) as caught:
        sinks.verify(spark, str(target), chosen, table.columns, len(ROWS) + 1)
    assert caught.value.gate == "G5"


def test_one_column_in_a_single_file(spark, tmp_path):
    frame = spark.createDataFrame([("a",), (None,), ("c",)], "only string").repartition(3)
    chosen = FileOptions(single_file=True)
    sinks.write_table(frame, str(tmp_path / "staged"), chosen)
    sinks.publish(spark, str(tmp_path / "staged"), str(tmp_path / "out.csv"), chosen, ["only"])
    assert sorted((tmp_path / "out.csv").read_text().splitlines()) == ['""', "a", "c", "only"]


def test_a_single_file_has_a_size_limit(spark, tmp_path):
    frame = spark.range(200_000).selectExpr("id", "repeat('x', 10) AS s")
    chosen = FileOptions(single_file=True, max_single_file_mb=1)
    sinks.write_table(frame, str(tmp_path / "staged"), chosen)
    with pytest.raises(WriteVerificationError):
        sinks.publish(spark, str(tmp_path / "staged"), str(tmp_path / "out.csv"), chosen, ["id", "s"])
    assert not (tmp_path / "out.csv").exists()


def test_target_guard(spark, tmp_path):
    sinks.check_target_empty(spark, str(tmp_path / "none"), "G1")
    (tmp_path / "empty.csv").write_text("")
    sinks.check_target_empty(spark, str(tmp_path / "empty.csv"), "G1")
    (tmp_path / "full.csv").write_text("x")
    with pytest.raises(FileGuardError):
        sinks.check_target_empty(spark, str(tmp_path / "full.csv"), "G1")
    with pytest.raises(WriteVerificationError) as caught:
        sinks.check_target_empty(spark, str(tmp_path / "full.csv"), "G4")
    assert caught.value.gate == "G4"


def test_a_missing_target_is_noticed(spark, tmp_path):
    with pytest.raises(WriteVerificationError) as caught:
        sinks.verify(spark, str(tmp_path / "none"), FileOptions(), ["a"], 1)
    assert caught.value.gate == "G5"
