"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares rows and column names."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def _plain(value, digits: int):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, digits) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(x, digits) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v, digits)) for k, v in value.items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if value.__class__.__name__ == "Decimal":
        return round(float(value), digits) + 0.0
    return value


def rows_of(names, rows, digits: int = 6) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i], digits) for i in order) for row in rows)


def differences(spark, sf_dir: str, query, sql: str, digits: int = 6) -> list:
    """Empty if both sides agree; else a few rows of each side that the other lacks."""
    frame = query(spark, sf_dir)
    with duckdb.connect() as db:
        for path in Path(sf_dir).glob("*.parquet"):
            files = f"{path}/*.parquet" if path.is_dir() else str(path)
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{files}'")
        found = db.execute(sql)
        names = [x[0] for x in found.description]
        theirs = rows_of(names, found.fetchall(), digits)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()], digits)
    if sorted(frame.columns) != sorted(names):
        return [("columns", sorted(frame.columns), sorted(names))]
    more, less = ours - theirs, theirs - ours
    return ([("spark", sum(ours.values()), list(more.items())[:3]), ("sql", sum(theirs.values()), list(less.items())[:3])] if more or less else [])
