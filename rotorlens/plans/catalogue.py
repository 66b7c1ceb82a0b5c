"""Every query of the library by name, each with the SQL that states the same thing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decision_queries, ingest_queries, kernel_queries, model_queries, signal_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for part in (signal_queries, decision_queries, ingest_queries, kernel_queries, model_queries):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
