"""Every query of the library against its SQL, on the smallest tables."""

import os

import pytest

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(D):
        if f.endswith(".parquet"):
            c.execute(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return c


def names():
    from knotwork.plans.catalog import ORACLES

    return sorted(ORACLES)


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the driver's tables")
@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from knotwork.plans.catalog import ORACLES, QUERIES

    got = QUERIES[name](spark, D).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda x: sorted(map(repr, x[sorted(x.columns)].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
