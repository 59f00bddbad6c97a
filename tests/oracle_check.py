"""Compare a query with its SQL twin: rows, columns and values, in any order."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path


def cell(v: object) -> object:
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (datetime, date)):
        return str(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return float(repr(v))
    return v


def normal(rows, columns) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def duck_rows(sql: str, folder: str) -> tuple[list, list[str]]:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        source = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{source}')")
    cur = con.execute(sql)
    return cur.fetchall(), [c[0] for c in cur.description]
