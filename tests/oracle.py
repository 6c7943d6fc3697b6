"""Runs a registered query in Spark and its SQL in DuckDB and compares rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _value(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(sf_dir, name)}.parquet'")
    return con


def compare(spark, sf_dir: str, query, sql: str, con=None) -> str | None:
    """None if equal, else what differs."""
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    got = Counter(tuple(_value(r[c]) for c in columns) for r in frame.collect())
    con = con or connect(sf_dir)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns: spark {columns}, oracle {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = Counter(tuple(_value(r[i]) for i in order) for r in cursor.fetchall())
    if got == want:
        return None
    return (
        f"rows: spark {sum(got.values())}, oracle {sum(want.values())}; columns {columns}; "
        f"only spark {list((got - want).elements())[:3]}; only oracle {list((want - got).elements())[:3]}"
    )
