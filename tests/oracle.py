"""Comparison of a Spark result with a SQL twin's."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def bag(rows, columns) -> Counter:
    return Counter(tuple(r[c] for c in columns) for r in rows)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = bag((dict(zip(names, r, strict=True)) for r in result.fetchall()), columns)
    ours = bag((r.asDict() for r in df.collect()), columns)
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
