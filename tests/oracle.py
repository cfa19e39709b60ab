"""Rows of a Spark query against rows of SQL on the same tables."""

import datetime
import glob
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        p = f"{p}/*.parquet" if os.path.isdir(p) else p
        if glob.glob(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(int(v)) if hasattr(v, "as_tuple") else repr(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def same(spark, sf_dir, query, sql):
    df = query(spark, sf_dir)
    r = connect(sf_dir).execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(names, r.fetchall())
