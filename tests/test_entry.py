"""The driver's entry points; every query with SQL is held against DuckDB at the smallest scale."""

from __future__ import annotations

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from lamina.plans import catalogue

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in DATA.iterdir():
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return round(x, 6) if math.isfinite(x) else str(x)
    return bytes(x).hex() if isinstance(x, (bytes, bytearray)) else x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(map(_plain, r)) for r in df.select(*columns).collect()), key=repr)
    found = duck.execute(f"SELECT {', '.join(columns)} FROM ({catalogue.ORACLES[name]})").fetchall()
    assert got == sorted((tuple(map(_plain, r)) for r in found), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 1500
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
