"""Run a query on both engines and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import time

import duckdb
from pyspark.sql import DataFrame


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


def compare(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty when equal, else what differs."""
    started = time.time()
    left = rows_of(df.columns, df.collect())
    print(f"     Spark {time.time() - started:.1f}s ({len(left)} rows)", end="", flush=True)
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    right = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(columns)}"
    if left == right:
        return ""
    only_left = [r for r in left if r not in set(right)][:3]
    only_right = [r for r in right if r not in set(left)][:3]
    return f"{len(left)} / {len(right)} rows; only Spark {only_left}; only SQL {only_right}"
