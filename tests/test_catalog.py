"""Every query with an oracle against DuckDB on the smallest tables; the others run and have rows."""

import os

import pytest

from epochal import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{DATA}/{name}'")
    return con


def plain(v):
    return "null" if v is None else f"{float(v):.6f}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    expected = sorted(tuple(map(plain, row)) for row in cursor.fetchall())
    assert sorted(tuple(map(plain, row)) for row in got.select(*[got[c] for c in columns]).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    catalog.queries()[name](spark, DATA).collect()


def test_flagship_is_registered():
    assert catalog.FLAGSHIP in catalog.queries()
