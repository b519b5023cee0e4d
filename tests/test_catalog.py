"""Registered queries against their SQL on the smallest tables, where these are at hand."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
NAMES = ["descendants_of_regions", "levels_divisors", "closure_doubling_divisors", "all_paths", "longest_path", "execution_plan", "merge_keep_second", "dsl_precedence", "version_at"]
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    from arbora.plans import catalog

    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = con.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda df: sorted(tuple("" if v is None else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
