"""Every query with an oracle equals DuckDB: row count, columns and values, in any order."""

import math

import duckdb
import pytest

from flowquarry.plans import all_queries

QUERIES, ORACLES = all_queries()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return str(v) if not isinstance(v, (int, type(None))) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=repr)
    if name not in ORACLES:
        assert len(rows) > 0
        return
    out = duck.execute(ORACLES[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)
    assert len(rows) == len(want) and len(rows) > 0
    for a, b in zip(rows, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) < 1e-4) for x, y in zip(a, b, strict=True)), (a, b)
