"""Run one registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


SAME_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_gaps(df, con, sql):
    cur = con.execute(f"DESCRIBE {sql}")
    duck = {r[0]: r[1] for r in cur.fetchall()}
    return [(n, t, duck.get(n)) for n, t in df.dtypes if SAME_TYPE.get(t) != duck.get(n)]


def differences(spark, con, fn, sql, sf_dir):
    """Empty string when equal, else a short account of what differs."""
    df = fn(spark, sf_dir)
    gaps = type_gaps(df, con, sql)
    if gaps:
        return f"types: {gaps}"
    sc, srows = spark_rows(df)
    dc, drows = duck_rows(con, sql)
    if sc != dc:
        return f"columns: {sc} != {dc}"
    if srows != drows:
        sset, dset = set(srows), set(drows)
        only_s = [r for r in srows if r not in dset][:3]
        only_d = [r for r in drows if r not in sset][:3]
        return f"rows {len(srows)} vs {len(drows)}; spark only {only_s}; sql only {only_d}"
    if not srows:
        return "no rows"
    return ""
