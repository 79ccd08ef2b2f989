"""Run registered queries next to their SQL in DuckDB and compare names, counts and values."""

from __future__ import annotations

import datetime
import math
import time
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) and abs(value) < 1e15 else repr(value) if not math.isinf(value) else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str, query) -> dict:
    start = time.time()
    df = query.run(spark, folder)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    if query.sql is None:
        return {"name": name, "ok": None, "rows": len(left), "seconds": seconds}
    start = time.time()
    cursor = con.execute(query.sql)
    columns = [c[0] for c in cursor.description]
    right = _rows(columns, cursor.fetchall())
    result = {"name": name, "ok": left == right and sorted(columns) == sorted(df.columns), "rows": len(left),
              "seconds": seconds, "sql_seconds": time.time() - start}
    if not result["ok"]:
        gone, new = [r for r in right if r not in left][:2], [r for r in left if r not in right][:2]
        result["detail"] = f"columns {sorted(df.columns)} / {sorted(columns)}; rows {len(left)} / {len(right)}; spark only {new}; sql only {gone}"
    return result
