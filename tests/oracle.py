"""A query's rows and those of its SQL, in a form that can be compared."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)


def sql_rows(con, sql):
    r = con.sql(sql)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    return sorted(r.columns), sorted((tuple(plain(row[i]) for i in at) for row in r.fetchall()), key=repr)
