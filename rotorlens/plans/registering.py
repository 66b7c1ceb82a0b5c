"""A decorator that registers a query with the SQL that states the same thing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registrar(queries: dict, oracles: dict) -> Callable:
    def query(sql: str | None = None) -> Callable:
        def take(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return take

    return query


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some digits, so that the order of additions does not show."""
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])
