"""Every query of the driver's tables against its SQL, and the entry module's contract."""

import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import driver

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    return round(float(v), 6) if isinstance(v, (int, float, decimal.Decimal)) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in found), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.mark.parametrize("name", sorted(driver.ORACLE))
def test_query_equals_sql(spark, sql, name):
    df = driver.QUERIES[name](spark, SF)
    result = sql.execute(driver.ORACLE[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(driver.QUERIES) - set(driver.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert driver.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
