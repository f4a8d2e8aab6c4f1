"""Runs a query and its SQL on the same tables and compares them as the driver does: by sorted columns and rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple(f"{x:.9g}" if isinstance(x, float) else repr(x) for x in r) for r in frame.itertuples(index=False))


def assert_same(spark, queries, oracles, name, sf_dir):
    ours, theirs = queries[name](spark, sf_dir).toPandas(), duck(sf_dir).sql(oracles[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
