"""Runs registered queries beside their SQL counterparts."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

from recordloom.session import TABLES

DATA = os.environ.get("RECORDLOOM_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _type_name(t: str) -> str:
    t = str(t).lower()
    return {"varchar": "string", "integer": "int", "timestamp": "timestamp_ntz", "tinyint": "tinyint", "blob": "binary",
            "float": "float"}.get(t, t.replace(" ", ""))


def _cell(v):
    if v is None:
        return ""
    if isinstance(v, Decimal):
        return format(v, "f")
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def compare(df, con, sql: str) -> list[str]:
    """Differences in schema, number of rows, and values; empty when equal."""
    rel = con.sql(sql)
    ours = {c: _type_name(t) for c, t in df.dtypes}
    theirs = {c: _type_name(t) for c, t in zip(rel.columns, rel.types, strict=True)}
    problems = []
    if ours != theirs:
        problems.append(f"schema {[(c, ours.get(c), theirs.get(c)) for c in sorted(set(ours) | set(theirs)) if ours.get(c) != theirs.get(c)]}")
        if set(ours) != set(theirs):
            return problems
    cols = sorted(ours)
    mine = sorted(tuple(_cell(r[c]) for c in cols) for r in df.select(*cols).collect())
    want = sorted(tuple(_cell(v) for v in row) for row in rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    if len(mine) != len(want):
        problems.append(f"rows {len(mine)} vs {len(want)}")
    if mine != want:
        a, b = set(mine), set(want)
        problems.append(f"values {cols}: ours {sorted(a - b)[:3]} theirs {sorted(b - a)[:3]}")
    return problems
