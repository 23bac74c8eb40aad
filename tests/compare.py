"""Run registered queries beside their SQL and compare the results cell by cell."""

from __future__ import annotations

import datetime
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_engine(folder: str) -> duckdb.DuckDBPyConnection:
    engine = duckdb.connect()
    engine.sql("set timezone = 'UTC'")
    for table in TABLES:
        engine.sql(f"create view {table} as from '{folder}/{table}.parquet'")
    return engine


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return (0, "")
    if isinstance(value, bool):
        return (1, str(value))
    if isinstance(value, (int, float)):
        return (2, f"{value:.6f}")
    if isinstance(value, datetime.datetime):
        return (3, value.replace(tzinfo=None).isoformat())
    return (4, str(value))


def normal(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return [columns[n] for n in order], sorted(tuple(_cell(row[n]) for n in order) for row in rows)


def compare(spark, engine, name: str, query, sql: str | None, folder: str) -> dict:
    start = time.time()
    df = query(spark, folder)
    got = normal(df.columns, df.collect())
    spent = time.time() - start
    if sql is None:
        return {"name": name, "ok": bool(got[1]), "rows": len(got[1]), "sec": spent, "why": "rows only"}
    start = time.time()
    relation = engine.sql(sql)
    want = normal(relation.columns, relation.fetchall())
    why = ""
    if got[0] != want[0]:
        why = f"columns {got[0]} != {want[0]}"
    elif len(got[1]) != len(want[1]):
        why = f"rows {len(got[1])} != {len(want[1])}"
    elif got[1] != want[1]:
        why = str(next((a, b) for a, b in zip(got[1], want[1]) if a != b))
    return {"name": name, "ok": not why, "rows": len(got[1]), "sec": spent, "why": why, "sql": time.time() - start}
