"""Queries of the subpackage that have SQL give the rows that DuckDB gives."""

import os

import duckdb
import pytest

from skein.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    result = con.execute(ORACLE_SQL[name])
    at = {c[0]: i for i, c in enumerate(result.description)}
    assert sorted(at) == columns
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(repr(tuple(r[at[c]] for c in columns)) for r in result.fetchall())
