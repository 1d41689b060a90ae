import os

import pytest

import __spark_entry__ as entry
from glyphmill import queries

SF = "/root/testdata/sf0.001"


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_flagship(spark):
    assert {r["kind"] for r in entry.entry(spark).collect()} >= {"ident", "int"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    other = con.execute(queries.ORACLES[name])
    order = [c[0] for c in other.description]
    assert sorted(order) == sorted(df.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(*(f"`{c}`" for c in order)).collect()), key=key) == sorted(map(tuple, other.fetchall()), key=key)
