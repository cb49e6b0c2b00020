"""The operators against their SQL, on the smallest tables."""

import os

import duckdb
import pytest

from folioscan.llm import queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, DATA).toPandas()
    assert sorted(got.columns) == columns
    rows = lambda f: sorted(map(tuple, f[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)
