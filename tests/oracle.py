"""Holds a query's rows against its SQL in DuckDB, whatever the order of rows and columns."""

import datetime
import decimal
import glob
import os


def value(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{round(v, 5) + 0.0:.5f}".rstrip("0").rstrip(".")
    if isinstance(v, decimal.Decimal):
        return value(float(v)) if v != int(v) else str(int(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(value, v)) + "]"
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted("|".join(value(r[n]) for n in names) for r in table.to_pylist())


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con
