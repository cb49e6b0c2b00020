"""The queries against their SQL, on the smallest tables; values are compared as text, numbers to six digits."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from folioscan.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def shown(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(shown, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA).toPandas()
    if name not in catalogue.oracle_sql():
        assert len(got)
        return
    want = duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_recall_of_the_approximate_search(spark, size):
    data = DATA.replace("sf0.001", size)
    if not os.path.isdir(data):
        pytest.skip("the test tables are not here")
    found = {(r["query_id"], r["vec_id"]) for r in catalogue.lsh_topk(spark, data).collect()}
    exact = {(r["query_id"], r["vec_id"]) for r in catalogue.knn_topk(spark, data).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)


@pytest.mark.parametrize("room", [1, 700])
def test_questions_in_several_blocks(spark, monkeypatch, room):
    from folioscan.operators import retrieve

    want = rows(catalogue.knn_topk(spark, DATA).toPandas())
    monkeypatch.setattr(retrieve, "BLOCK_CELLS", room)
    monkeypatch.setattr(retrieve, "PART", 100)
    assert rows(catalogue.knn_topk(spark, DATA).toPandas()) == want
    near = rows(catalogue.similarity_search_wide(spark, DATA).toPandas())
    monkeypatch.undo()
    assert near == rows(catalogue.similarity_search_wide(spark, DATA).toPandas())


def test_risk_check_has_rows_of_either_kind(spark):
    got = {(r["variant"], r["is_honest"], r["has_citation"], r["risk_level"]) for r in catalogue.risk_check(spark, DATA).collect()}
    assert {("cited", False, True, "low"), ("honest", True, False, "low"), ("both", True, True, "low"), ("plain", False, False, "medium")} <= got
