"""The registered queries against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatch.plans import driver_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(driver_queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
