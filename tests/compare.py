"""Holds a query against its SQL in DuckDB, rows as sets with repeats, as text."""

from pathlib import Path

import duckdb
import pandas as pd


def cell(v) -> str:
    if v is None or v is pd.NA or v != v:
        return "null"
    if type(v).__name__.startswith("bool"):
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__name__.startswith(("int", "uint", "float")):
        return repr(float(v))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


def oracle(sql: str, data: str) -> pd.DataFrame:
    con = duckdb.connect()
    for p in Path(data).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con.sql(sql).df()
