"""Every query of the catalogue that has SQL gives the rows that DuckDB gives."""

import os

import duckdb
import pytest

from skein.plans import catalogue, catalogue_facts  # noqa: F401: adds its queries


def norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(norm, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    got = sorted(repr(tuple(map(norm, r))) for r in df.select(*sorted(df.columns)).collect())
    result = duck.execute(catalogue.SQL[name])
    columns = [c[0] for c in result.description]
    at = [columns.index(c) for c in sorted(columns)]
    wanted = sorted(repr(tuple(norm(r[i]) for i in at)) for r in result.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert got == wanted
    assert wanted
