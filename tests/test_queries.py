"""Every registered query of the core against its SQL, over the smallest tables."""

import math
from pathlib import Path

import pytest

from fieldweave.plans import queries as core


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def value(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, sf_dir, duck, name):
    df = core.queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in core.oracle_sql():
        assert got[1]
        return
    r = duck.execute(core.oracle_sql()[name])
    want = rows_of([d[0] for d in r.description], r.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]), got[1][:3], want[1][:3])
    assert got[1] == want[1], next((a, b) for a, b in zip(got[1], want[1], strict=True) if a != b)
