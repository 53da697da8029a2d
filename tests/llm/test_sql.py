"""Queries that SQL can express, against their SQL over the smallest tables."""

from pathlib import Path

import pytest

from fieldweave.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    import duckdb

    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, sf_dir)
    r = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(x) for x in df.select(*names).collect()) == sorted(r.fetchall())
