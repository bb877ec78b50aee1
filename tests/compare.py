"""Rows of a query against those of its SQL in DuckDB, whatever their order."""

import glob
import math
import os

import duckdb


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)) or hasattr(v, "asDict"):
        return str([cell(x) for x in v])
    return str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())


def expected(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = con.execute(sql)
    names = [x[0] for x in got.description]
    columns = sorted(names)
    return columns, sorted(tuple(cell(r[names.index(c)]) for c in columns) for r in got.fetchall())
