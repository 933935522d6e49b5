"""Rows of a query against those of its SQL in DuckDB: names, number and values, order aside."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else x)
            if df[c].map(lambda x: x is None or isinstance(x, (int, float, bool, np.number))).all() and not df[c].map(lambda x: isinstance(x, bool)).any():
                df[c] = df[c].astype(float)
        elif df[c].dtype != bool:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), ignore_index=True, key=lambda s: s.map(lambda x: f"{x:020.4f}" if isinstance(x, float) else str(x)))


def differ(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} and {len(want)}"
    a, b = _plain(got), _plain(want)
    for c in a:
        if a[c].dtype == float and b[c].dtype == float:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        else:
            bad = a[c].astype(str) != b[c].astype(str)
        if bad.any():
            return f"{c}: {int(bad.sum())} differ, first {a[c][bad].iloc[0]!r} and {b[c][bad].iloc[0]!r}"
    return None
