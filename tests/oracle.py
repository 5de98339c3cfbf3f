"""Compares a query with its SQL in DuckDB."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


def assert_same(spark, query, sql, sf):
    got = query(spark, sf)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    a = sorted(repr([_plain(x) for x in r]) for r in got.select(*names).collect())
    b = sorted(repr([_plain(x) for x in r]) for r in want.fetchall())
    assert a == b
