import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from colloquy.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("conversations", "embeddings", "events")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def clean(x):
    return None if x is None or isinstance(x, float) and math.isnan(x) else round(x, 6) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, name):
    found = QUERIES[name](spark, SF)
    cols = sorted(found.columns)
    rows = sorted((str([clean(r[c]) for c in cols]) for r in found.collect()))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(str([clean(r[i]) for i in at]) for r in want.fetchall()) == rows


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
