"""Every registered query against its SQL counterpart in DuckDB."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from query_catalog import CATALOG
from tests.comparison import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def database():
    with connect(FOLDER) as connection:
        yield connection


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query(spark, database, name):
    frame = contract.queries()[name](spark, FOLDER)
    assert differences(frame, database, contract.oracle_sql()[name]) == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
