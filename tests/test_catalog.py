"""Every registered query against its SQL in DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lodestrata.plans import catalog, wire_catalog  # noqa: F401

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        p = f"{DATA}/{f}"
        c.execute(f"create view {f.split('.')[0]} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {f.split('.')[0]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(catalog.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert ours == theirs
