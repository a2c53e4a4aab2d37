"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from workload.check import TABLES, bag

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == bag(columns, result.fetchall())


def test_entry(spark):
    assert entry(spark).count() > 0


def test_scores_and_counts_agree(spark):
    """Scores stay in 0..100 and severities and categories count the same findings."""
    rows = QUERIES["stats"](spark, SF).collect()
    for r in rows:
        assert 0 <= r.health_score <= 100
        by_category = sum(
            r[c] for c in ("deprecated", "security", "performance", "bad_practice", "missing",
                           "inheritance", "data_integrity")
        )
        assert r.critical + r.warning + r.info == by_category
