"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__
from lexweft.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    result = con.execute(ORACLES[name])
    held = [d[0] for d in result.description]
    assert sorted(held) == columns
    want = sorted(repr(tuple(r[held.index(c)] for c in columns)) for r in result.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want
    spark.catalog.clearCache()


def test_reports(spark, small):
    assert QUERIES["q_report_json"](spark, small).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
