"""Every query against its SQL on the small tables."""

import decimal
import os

import duckdb
import pytest

from tradeloom import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    return round(v, 9) if isinstance(v, float) else v.normalize() if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in catalog.oracle_sql():
        assert got
        return
    rel = duck.sql(catalog.oracle_sql()[name])
    at = [list(rel.columns).index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
