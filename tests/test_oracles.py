"""Every query of the engine against its SQL, in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodestar.plans import catalog

SF = "/root/testdata/sf0.001"
SLOW = {"r6_dead_letters", "a12_w8_pagerank", "t4_w3_graph_search", "r1_r4_r7_ledger_stream"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows_of(rows):
    plain = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    result = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert rows_of(df.select(*columns).collect()) == rows_of(expected)


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
