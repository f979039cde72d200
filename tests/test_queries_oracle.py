"""Every registered query against its DuckDB oracle on the small fixture (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from parlance.plans.catalog import LONG_QUERIES, QUERIES
from tools.check_oracle import TABLES, rows_of

SF_SMALL = "/root/testdata/sf0.001"

NAMES = sorted(set(QUERIES) - LONG_QUERIES)  # test_report.py has the others


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield con
    con.close()


def test_every_query_has_an_oracle():
    assert set(NAMES) == set(QUERIES) - LONG_QUERIES <= set(E.oracle_sql()) and set(QUERIES) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    cols, recs = df.columns, [tuple(r) for r in df.collect()]
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, recs) == rows_of(dcols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "text" in df.columns
