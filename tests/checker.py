"""Side-by-side comparison of a query and its SQL."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return db


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool):
        return str(value)
    return value if value is None else str(value)


def _kind(type_name: str) -> str:
    name = type_name.lower().split("(")[0]
    if name in ("bigint", "integer", "int", "long", "smallint", "short", "hugeint", "tinyint"):
        return "hugeint" if name == "hugeint" else "int"
    if name in ("double", "float", "decimal"):
        return "decimal" if name == "decimal" else "double"
    return {"varchar": "string", "bool": "boolean"}.get(name, name)


def spark_rows(df) -> tuple[list[str], dict[str, str], list[tuple]]:
    names = sorted(df.columns)
    kinds = {n: _kind(t) for n, t in df.dtypes}
    rows = [tuple(_cell(r[n]) for n in names) for r in df.collect()]
    return names, kinds, sorted(rows, key=repr)


def sql_rows(db, sql: str) -> tuple[list[str], dict[str, str], list[tuple]]:
    found = db.sql(sql)
    kinds = {n: _kind(str(t)) for n, t in zip(found.columns, found.types)}
    at = {n: i for i, n in enumerate(found.columns)}
    names = sorted(found.columns)
    rows = [tuple(_cell(r[at[n]]) for n in names) for r in found.fetchall()]
    return names, kinds, sorted(rows, key=repr)


def differences(df, db, sql: str) -> list[str]:
    names, kinds, rows = spark_rows(df)
    sql_names, sql_kinds, expected = sql_rows(db, sql)
    if names != sql_names:
        return [f"columns {names} against {sql_names}"]
    out = []
    if kinds != sql_kinds:
        out.append(f"types {kinds} against {sql_kinds}")
    if len(rows) != len(expected):
        out.append(f"{len(rows)} rows against {len(expected)}")
    wrong = [(a, b) for a, b in zip(rows, expected) if a != b]
    if wrong:
        out.append(f"{len(wrong)} rows differ, first {str(wrong[0])[:600]}")
    if not rows:
        out.append("no rows")
    return out
