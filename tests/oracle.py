"""Runs registered queries and their SQL on the same tables and compares the rows."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NA:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 6) + 0.0
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted((tuple(_plain(x) for x in r) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    a, b = rows(spark_frame), rows(sql_frame)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(off)} of {len(a)} rows differ, as {off[:2]}" if off else ""
