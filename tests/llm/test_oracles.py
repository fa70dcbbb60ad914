"""Queries with SQL give the same rows in DuckDB."""

import pytest

from talktide.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    known = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in known.description]
    found = queries.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == sorted(known.fetchall(), key=str)
