"""Compares a Spark result with a DuckDB result: columns, rows in any order, values to nine places."""

import os

import duckdb
import pandas as pd


def one(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, bool):
        return v
    return round(float(v), 9) if isinstance(v, (int, float)) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(one, r)) for r in df.astype(object).itertuples(index=False, name=None)), key=repr)


def database(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            path = f"{folder}/{name}" + ("/*.parquet" if os.path.isdir(f"{folder}/{name}") else "")
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def same(found: pd.DataFrame, wanted: pd.DataFrame) -> bool:
    return sorted(found.columns) == sorted(wanted.columns) and rows(found) == rows(wanted)
