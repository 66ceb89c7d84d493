"""Every query with an oracle equals its DuckDB SQL on the sf0.001 tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sluice.catalog import ORACLE, QUERIES, load_all

TABLES = ["documents", "labels", "embeddings"]
load_all()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_query_registered_with_callable():
    assert len(QUERIES) >= 80
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(ORACLE[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert got == _rows(cols, cur.fetchall())


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and {"seed", "split", "label", "latent", "n"} <= set(rows[0].asDict())
