"""Every registered query of the reference's operators against its SQL, at the smallest scale."""

import duckdb
import pytest

from check import rows
from paperloom import catalog
from paperloom.fixtures import TABLES

FOLDER = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_its_sql(spark, duck, key):
    df = catalog.queries()[key](spark, FOLDER)
    cur = duck.execute(SQL[key])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cur.description], cur.fetchall())
