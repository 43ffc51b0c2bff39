"""Reading delimited text, compared with what pandas reads from the same file."""

from __future__ import annotations

import io

import pandas as pd
import pytest

from tablewright.errors import ConfigValidationError, FileGuardError
from tablewright.operators.filters import apply_filters
from tablewright.sources import tables
from tablewright.sources.tables import SourceTables, needs_multi_line, plain_types, prefix_columns, read_table
from tablewright.spec import ExpressionFilter, FileOptions, load
from tests import samples


def read(spark, tmp_path, text, schema=None, **options):
    path = tmp_path / "table.csv"
    path.write_bytes(text if isinstance(text, bytes) else text.encode(options.get("encoding", "utf-8")))
    return read_table(spark, str(path), FileOptions(**options), schema)


def rows(frame):
    return [tuple(row) for row in frame.collect()]


TEXTS = [
    samples.SALES_ORDERS,
    samples.PRODUCTS,
    'a,b\n"x, y","say ""hi"""\n"two\nlines",z\n',
    "a,b\n 1 ,x \n2, y\n",
    "a\ntrue\nFalse\nTRUE\n",
    "a,b\nTrue,1\n,2\n",
    "a\n1e5\n.5\n5.\n",
    "a\ninf\n-Infinity\n1\n",
    "a\n1e400\n1\n",
    "a\n18446744073709551616\n1\n",
    "a\n1d\n2\n",
    "a\n0x1\n2\n",
    "a\n1 2\n",
    "a\n+1\n-2\n00012\n",
    "a,b\n2024-01-01,NA\n2024-01-02,null\n",
    'a,b\nx,n/a\n"",#N/A N/A\n<NA>,1.#IND\n',
    "a,b,c\n1,,3\n4\n5,6\n",
    "a,b\n1,2\n\n   \n3,4\n",
    "a,b\n,1\n,2\n",
    "﻿a,b\n1,x\n",
    "a,,c\n1,2,3\n",
]


@pytest.mark.parametrize("text", TEXTS, ids=range(len(TEXTS)))
def test_against_pandas(spark, tmp_path, text):
    frame = read(spark, tmp_path, text)
    expected = pd.read_csv(io.StringIO(text.removeprefix("﻿")))
    assert frame.columns == [str(name) for name in expected.columns]
    assert rows(frame) == [
        tuple(None if pd.isna(v) else v for v in row) for row in expected.itertuples(index=False)
    ]


def test_types(spark, tmp_path):
    frame = read(spark, tmp_path, "i,f,b,s,n,d\n1,1.5,true,x,,2024-01-01\n,2,,1x,,2024-01-02\n")
    assert [kind for _, kind in frame.dtypes] == ["bigint", "double", "boolean", "string", "double", "string"]


def test_dialects(spark, tmp_path):
    assert rows(read(spark, tmp_path, "id|name\n1|Ada\n", delimiter="|")) == [(1, "Ada")]
    assert rows(read(spark, tmp_path, "a,b\n'x,y',2\n", quote_char="'")) == [("x,y", 2)]
    assert rows(read(spark, tmp_path, "a\nué\n", encoding="latin-1")) == [("ué",)]
    headless = read(spark, tmp_path, "1,x\n2,y\n", header_row=False)
    assert headless.columns == ["0", "1"] and rows(headless) == [(1, "x"), (2, "y")]
    assert prefix_columns(headless, "t").columns == ["t__0", "t__1"]


def test_rows_with_too_many_fields(spark, tmp_path):
    for text in ("a,b\n1,2,3\n4,5\n", "a,b\n1,2,\n", "a,b\n1,2\n3,4,,,\n"):
        for schema in (None, "a INT, b INT"):
            with pytest.raises(FileGuardError) as caught:
                read(spark, tmp_path, text, schema)
            assert caught.value.gate == "G1"
    assert rows(read(spark, tmp_path, "a,b\n1\n3,4\n")) == [(1, None), (3, 4)]


def test_declared_schema(spark, tmp_path):
    frame = read(spark, tmp_path, "a,b,c\n1,2.50,2024-01-01\nNA,,\n", "x STRING, y DECIMAL(9,2), z DATE")
    assert frame.dtypes == [("x", "string"), ("y", "double"), ("z", "timestamp_ntz")]
    assert rows(frame)[0][:2] == ("1", 2.5)
    assert rows(frame)[1] == (None, None, None)
    with pytest.raises(FileGuardError):
        read(spark, tmp_path, "a,b\n1,2\n", "x STRING")


def test_tables_without_rows(spark, tmp_path):
    frame = read(spark, tmp_path, "a,b\n")
    assert frame.columns == ["a", "b"] and rows(frame) == []
    with pytest.raises(FileGuardError):
        read(spark, tmp_path, "")


def test_repeated_column_names(spark, tmp_path):
    with pytest.raises(FileGuardError) as caught:
        read(spark, tmp_path, "a,b,a\n1,2,3\n")
    assert "a" in caught.value.message


def test_guards(spark, tmp_path):
    with pytest.raises(FileGuardError) as caught:
        read_table(spark, str(tmp_path / "none.csv"), FileOptions())
    assert caught.value.gate == "G1"
    big = "a\n" + "x" * 2 * 1024 * 1024
    with pytest.raises(FileGuardError):
        read(spark, tmp_path, big, max_file_size_mb=1)
    assert read(spark, tmp_path, big, max_file_size_mb=3).count() == 1
    with pytest.raises(ConfigValidationError) as caught:
        read(spark, tmp_path, "a\n1\n", format="XLSX")
    assert caught.value.gate == "G0"
    assert rows(read(spark, tmp_path, "a\n1\n", format="csv")) == [(1,)]


def test_large_files_are_split_unless_fields_hold_line_breaks(spark, tmp_path):
    path = tmp_path / "large.csv"
    body = "".join(f'{i},"quoted, {i}"\n' for i in range(2000))
    path.write_text("id,text\n" + body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert not needs_multi_line(spark, str(path), FileOptions())
        frame = read_table(spark, str(path), FileOptions())
        assert frame.rdd.getNumPartitions() > 1
        assert sorted(rows(frame)) == [(i, f"quoted, {i}") for i in range(2000)]
        path.write_text("id,text\n" + body + '2000,"two\nlines"\n')
        assert needs_multi_line(spark, str(path), FileOptions())
        assert sorted(rows(read_table(spark, str(path), FileOptions())))[-1] == (2000, "two\nlines")
        assert not needs_multi_line(spark, str(path), FileOptions(multi_line="never"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folders_and_parquet(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "part-0.csv").write_text("a,b\n1,x\n")
    (folder / "part-1.csv").write_text("a,b\n2,y\n")
    assert sorted(rows(read_table(spark, str(folder), FileOptions()))) == [(1, "x"), (2, "y")]
    stored = spark.sql("SELECT 1 AS i, 2.5BD AS d, DATE'2024-01-01' AS t, CAST(1.5 AS FLOAT) AS f, 'x' AS s")
    stored.write.parquet(str(tmp_path / "p"))
    frame = read_table(spark, str(tmp_path / "p"), FileOptions(format="parquet"))
    assert dict(frame.dtypes) == {"i": "int", "d": "double", "t": "timestamp_ntz", "f": "double", "s": "string"}


def test_files_of_a_folder_have_the_same_columns(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    (folder / "p1.csv").write_text("id,t\n1,x\n")
    (folder / "p2.csv").write_text("t,id\ny,2\n")
    with pytest.raises(FileGuardError, match="columns"):
        read_table(spark, str(folder), FileOptions())
    for mode in ("never", "always"):
        with pytest.raises(FileGuardError):
            read_table(spark, str(folder), FileOptions(multi_line=mode))
    # Spelled otherwise, but the same names; without a header nothing is compared.
    (folder / "p2.csv").write_text('\ufeff"id","t"\r\n2,y\r\n')
    assert sorted(rows(read_table(spark, str(folder), FileOptions()))) == [(1, "x"), (2, "y")]
    (folder / "p2.csv").write_text("2,y\n")
    (folder / "p1.csv").write_text("1,x\n")
    assert sorted(rows(read_table(spark, str(folder), FileOptions(header_row=False)))) == [(1, "x"), (2, "y")]


def test_only_files_with_line_breaks_in_fields_are_read_whole(spark, tmp_path):
    folder = tmp_path / "many of them.csv"
    folder.mkdir()
    wanted = []
    for k in range(12):
        body = "".join(f'{i},"quoted, {i}"\n' for i in range(k * 300, k * 300 + 300))
        wanted += [(i, f"quoted, {i}") for i in range(k * 300, k * 300 + 300)]
        (folder / f"part {k}.csv").write_text("id,text\n" + body)
    (folder / "odd.csv").write_text('id,text\n9000,"two\nlines"\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        frame = read_table(spark, str(folder), FileOptions())
        assert sorted(rows(frame)) == [*wanted, (9000, "two\nlines")]
        assert frame.rdd.getNumPartitions() > 13
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_wildcards(spark, tmp_path):
    for name, text in (("a1.csv", "id\n1\n"), ("a2.csv", "id\n2\n"), ("b1.csv", "id\n3\n")):
        (tmp_path / name).write_text(text)
    assert sorted(rows(read_table(spark, str(tmp_path / "a*.csv"), FileOptions()))) == [(1,), (2,)]
    with pytest.raises(FileGuardError, match="not found"):
        read_table(spark, str(tmp_path / "c*.csv"), FileOptions())
    with pytest.raises(FileGuardError, match="exceeds"):
        (tmp_path / "a3.csv").write_text("id\n" + "1" * 2 * 1024 * 1024)
        read_table(spark, str(tmp_path / "a*.csv"), FileOptions(max_file_size_mb=1))


def test_each_source_is_typed_once_and_may_be_kept(spark, tmp_path, monkeypatch):
    samples.write_inputs(tmp_path, employees=samples.EMPLOYEES, departments=samples.DEPARTMENTS)
    pipeline = load(samples.employees_config(tmp_path))
    calls = []
    actual = tables.read_table
    monkeypatch.setattr(tables, "read_table", lambda *a: calls.append(a[1]) or actual(*a))
    sources = SourceTables(spark, pipeline, persist=True)
    for blueprint in pipeline.blueprints:
        for table in blueprint.tables:
            sources.read(table)
    assert len(calls) == 2
    assert sources.read(pipeline.blueprints[0].root).is_cached
    assert not sources.read(pipeline.blueprints[1].joins[0].table).is_cached
    sources.release()
    assert not sources.read(pipeline.blueprints[0].root).is_cached


def test_supplied_frames_are_brought_to_plain_types(spark):
    frame = spark.sql("SELECT CAST(1.25 AS DECIMAL(5,2)) AS d, TIMESTAMP'2024-01-01 00:00:00' AS t")
    assert dict(plain_types(frame).dtypes) == {"d": "double", "t": "timestamp_ntz"}


def test_unusual_column_names(spark, tmp_path):
    frame = read(spark, tmp_path, "a.b,c d,e`f,Id,id\n1,2,x,3,4\n")
    assert frame.columns == ["a.b", "c d", "e`f", "Id", "id"] and rows(frame) == [(1, 2, "x", 3, 4)]
    kept = apply_filters(prefix_columns(frame, "t"), [ExpressionFilter("`t.c d` == 2 and t.Id < t.id")])
    assert kept.columns == ["t__a.b", "t__c d", "t__e`f", "t__Id", "t__id"] and kept.count() == 1
