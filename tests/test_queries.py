"""Every query of the library against its SQL in DuckDB, over the whole small tables."""

import glob
import os

import duckdb
import pytest

from quillon.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def comparable(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf_small, duck, name):
    df = QUERIES[name](spark, sf_small)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_alike_twice(spark, sf_small, name):
    one, two = ([tuple(r) for r in QUERIES[name](spark, sf_small).collect()] for _ in range(2))
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
