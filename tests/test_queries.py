"""Every query with SQL against DuckDB on the smallest tables; the others run and keep a stable schema."""

import datetime
import decimal
import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from glossa import queries
from glossa.tables import BASE


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6g}"
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str)
    if name not in queries.ORACLE_SQL:
        assert got.schema == queries.QUERIES[name](spark, sf_dir).schema
        return
    want = duck.execute(queries.ORACLE_SQL[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert len(want.description) == len(columns)
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pmid", "score", "quality", "toxic"] and df.count() == 20


def test_import_needs_no_session():
    """The driver reads the names of all queries before it starts a session."""
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"], cwd=os.path.dirname(entry.__file__), check=True, timeout=120)


def test_registry(sf_dir):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert glob.glob(f"{sf_dir}/documents.parquet")
