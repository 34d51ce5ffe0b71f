"""Compares a Spark result with the DuckDB result of its oracle, value by value."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _family(value) -> str:
    if isinstance(value, (bool, np.bool_)):
        return "bool"
    if isinstance(value, (int, np.integer)):
        return "int"
    if isinstance(value, (float, np.floating)):
        return "float"
    return type(value).__name__


def _cell(value):
    if value is None or value is pd.NA or value is pd.NaT or (isinstance(value, float) and np.isnan(value)):
        return "null"
    kind = _family(value)
    if kind == "float":
        return f"float:{float(value)!r}"
    return f"{kind}:{value}"


def rows_of(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    ordered = frame[sorted(frame.columns)]
    columns = [[_cell(v) for v in ordered[c].tolist()] for c in ordered.columns]
    return sorted(zip(*columns))


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when both frames hold the same columns and rows."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return ""
    only_a, only_b = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
    shown = "\n".join(str(r)[:600] for r in only_a[:2]) + "\n--- oracle\n" + "\n".join(str(r)[:600] for r in only_b[:2])
    return f"{len(a)} rows, oracle {len(b)}; {len(only_a)} / {len(only_b)} differ\n{shown}"
