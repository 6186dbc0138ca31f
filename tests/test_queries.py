"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from postsieve.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "customer", "events", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    return f"{float(x):.9g}" if isinstance(x, int | float) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DIR)
    names = sorted(got.columns)
    have = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == names
    order = [rel.columns.index(c) for c in names]
    assert have == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
