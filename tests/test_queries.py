"""Every query with a SQL form against DuckDB; every other query gives rows with a stable schema."""

import math

import duckdb
import pytest

from loomgraph.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def told(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    rows = duck.execute(ORACLES[name])
    names = [d[0] for d in rows.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(told(r[names.index(c)]) for c in order) for r in rows.fetchall())
    assert sorted(tuple(told(r[c]) for c in order) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() > 0
