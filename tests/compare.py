"""Run a query and its SQL on the same tables and compare the rows."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database(folder=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(folder)):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def _text(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "dtype") and v.dtype.kind in "iuf" or isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.6g}"
    return str(v)[:10] if type(v).__name__ in ("date", "Timestamp") else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(_text, r)) for r in df[names].itertuples(index=False)), key=str)
