"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from marginalia.plans import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert ours == sorted((tuple(plain(r[k]) for k in at) for r in result.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_threads_by_gap_without_places(spark, tmp_path):
    """Events without an id have no place: they come last, as SQL has them, and begin no cluster."""
    rows = [(u, None if k == 7 else u * 1000 + k * k, None) for u in (1, 2, 3) for k in range(60)] + [(None, k, None) for k in (5, 6, 900, None)] + [(4, None, None)]
    spark.createDataFrame(rows, "user_id long, event_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT user_id, event_id, cluster, parent, is_reply FROM ({SQL['threads_by_gap']})").fetchall()
    got = QUERIES["threads_by_gap"](spark, str(tmp_path)).select("user_id", "event_id", "cluster", "parent", "is_reply").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
