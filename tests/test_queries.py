"""Every registered query against its SQL in DuckDB, over the smallest tables."""

import datetime
import decimal
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from workload.oracles import ORACLES
from workload.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return None if value != value else round(float(value), 9)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    return value.isoformat() if isinstance(value, datetime.date) else value


def test_every_query_has_a_check():
    assert set(ORACLES) == set(QUERIES)
    assert QUERIES.items() <= entry.queries().items() and ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def test_every_rule_fires(spark):
    found = QUERIES["rule_coverage"](spark, SF.replace("0.001", "0.01")).collect()
    assert len(found) == 44 and all(r["n"] > 0 for r in found)
    assert QUERIES["large_files"](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
