"""A query's rows beside those of its SQL."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime

import duckdb

from ledgerloom.sources.tables import TABLES


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in data)


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP"}


def differences(df, con, sql: str) -> str:
    """Empty if columns, their types and all rows agree."""
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs, want = rows([c[0] for c in cursor.description], cursor.fetchall())
    if names != theirs:
        return f"columns {names} and {theirs}"
    kinds = {c[0]: str(c[1]) for c in con.execute(f"DESCRIBE {sql}").fetchall()}
    odd = {c: (t, kinds[c]) for c, t in df.dtypes if KINDS.get(t, kinds[c]) != kinds[c]}
    if odd:
        return f"types {odd}"
    if not got and not want:
        return "no rows"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only ours {list((got - want).items())[:3]}; only theirs {list((want - got).items())[:3]}"
    return ""
