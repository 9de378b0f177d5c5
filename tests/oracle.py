"""Runs a query and its SQL and compares the rows, in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(frame[columns].astype(object).where(frame[columns].notna(), None).astype(str).values.tolist())


def same(spark, con, sf_dir, query, sql):
    mine, theirs = rows(query(spark, sf_dir).toPandas()), rows(con.sql(sql).df())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]
    return len(mine[1])
