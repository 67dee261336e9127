"""Runs a query and its SQL over the same tables and compares the rows."""

import decimal
import os

import duckdb


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    return repr(float(v)) if isinstance(v, decimal.Decimal) else repr(v)


def compare(spark, folder, query, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{folder}/{f}'")
    df = query(spark, folder)
    cols = sorted(df.columns)
    mine = sorted(tuple(_norm(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted(tuple(_norm(r[i]) for i in at) for r in rel.fetchall())
    assert len(mine) == len(theirs)
    assert mine == theirs
