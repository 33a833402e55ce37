"""Compare a Spark result with a DuckDB result, order-insensitively and exactly."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=lambda r: tuple(str(x) for x in r))


def differences(df, con, sql, limit=4):
    """Empty when both engines agree; otherwise a short description."""
    cur = con.execute(sql)
    dn, drows = rows_of([d[0] for d in cur.description], cur.fetchall())
    sn, srows = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if dn != sn:
        return f"columns: spark {sn} sql {dn}"
    if len(drows) != len(srows):
        return f"rows: spark {len(srows)} sql {len(drows)}; only spark {list(set(srows) - set(drows))[:2]}; only sql {list(set(drows) - set(srows))[:2]}"
    bad = [(a, b) for a, b in zip(srows, drows) if a != b]
    if bad:
        msg = []
        for a, b in bad[:limit]:
            msg.append(str([(n, x, y) for n, x, y in zip(sn, a, b) if x != y][:4]))
        return f"{len(bad)} of {len(srows)} rows differ: " + "; ".join(msg)
    return ""
