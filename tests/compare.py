"""Spark rows against DuckDB rows: columns by name, rows in any order, floats to nine places."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd


def value(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(value(y) for y in x)
    if isinstance(x, dict):
        return tuple(value(y) for y in x.values())
    if isinstance(x, (float, np.floating)):
        return None if math.isnan(x) else round(float(x), 9)
    return x.item() if hasattr(x, "item") else x


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    return sorted((tuple(map(value, r)) for r in df.itertuples(index=False, name=None)), key=repr)


def duck(sf_dir: str, tables) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c
