"""Every registered query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from foliant.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return db


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, dict):
        return str([plain(x) for x in v.values()])
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(str([plain(v) for v in row]) for row in zip(*(table.column(n).to_pylist() for n in names)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, DIR).toArrow()) == rows(duck.sql(ORACLES[name]).to_arrow_table())
