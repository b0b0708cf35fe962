"""Compare a query with its DuckDB SQL: names, row counts and values without regard to order."""

from __future__ import annotations

import math
from pathlib import Path


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _key(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, f"{v:.9g}")
    return (3, str(v).replace("T00:00:00", "").removesuffix(" 00:00:00"))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str:
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want, got = rows_of(want_names, cur.fetchall()), rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(want_names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(want_names)}"
    if got == want:
        return ""
    a, b = set(got), set(want)
    return f"{len(got)} and {len(want)} rows; only Spark {sorted(a - b)[:2]}; only SQL {sorted(b - a)[:2]}"
