"""Every query with oracle SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import math
import os
import re
from collections import Counter

import pytest

import __spark_entry__ as entry

duckdb = pytest.importorskip("duckdb")
DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return datetime.datetime(value.year, value.month, value.day).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    expected = Counter(repr(tuple(plain(dict(zip(names, row))[c]) for c in columns)) for row in cursor.fetchall())
    found = Counter(repr(tuple(plain(row[c]) for c in columns)) for row in df.collect())
    assert found == expected


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n not in ORACLES and (n.startswith("p6_") or not re.match(r"p\d+_", n))))
def test_runs(spark, name):
    df = QUERIES[name](spark, DIR)
    assert df.columns and len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
