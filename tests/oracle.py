"""Compare a Spark result with DuckDB's for the same query."""

import os

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{DATA}/{sf}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{DATA}/{sf}/{t}.parquet'")
    return c


def same(spark, query, sql, sf="sf0.001"):
    df = query(spark, f"{DATA}/{sf}")
    cols = sorted(df.columns)
    cursor = duck(sf).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    expected = sorted(repr([r[names.index(c)] for c in cols]) for r in cursor.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == expected
    return len(expected)
