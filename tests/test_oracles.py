"""Every reference query with an oracle against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from driftline.plans import catalog


def norm(v):
    if v is None:
        return ""
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v).split("+")[0]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, sf, con, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    got = con.execute(catalog.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert ours == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall())
