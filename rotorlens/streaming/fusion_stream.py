"""The fusion state machine on a stream: keyed state holds the pool and three run counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fusion import CONSECUTIVE, HYSTERESIS, POOL, TAU_FAULT, TAU_WARNING

STATE = "pool array<double>, rise int, warn int, clear int, status string, seen long"
OUT = "rec long, p_fault double, status string, n_obs_total long"


def advance(state: tuple, p: float, may: bool) -> tuple:
    """State after one more observation; the batch form folds the same rule."""
    pool, rise, warn, clear, status, seen = state
    pool = ([*pool, p])[-POOL:]
    mean = sum(pool) / len(pool)
    rise, warn, clear = (n + 1 if on else 0 for n, on in ((rise, mean >= TAU_FAULT), (warn, mean >= TAU_WARNING), (clear, mean < TAU_WARNING - HYSTERESIS)))
    if rise >= CONSECUTIVE and may:
        status = "Fault"
    elif warn >= CONSECUTIVE:
        status = "Fault" if status == "Fault" else "Warning"
    elif clear >= CONSECUTIVE:
        status = "Normal"
    return pool, rise, warn, clear, status, seen + 1


def fuse(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Observations of a batch are taken in order of (ts, event_id); later batches come after earlier ones."""
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    current = tuple(state.get) if state.exists else ([], 0, 0, 0, "Normal", 0)
    for p, may in zip(rows["p"], rows["may"]):
        current = advance(current, float(p), bool(may))
    state.update(current)
    yield pd.DataFrame([(key[0], sum(current[0]) / len(current[0]), current[4], current[5])], columns=["rec", "p_fault", "status", "n_obs_total"])


def fused(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """stream: rec, ts (timestamp), event_id, p, may. Rows later than the watermark are dropped by Spark."""
    return stream.withWatermark("ts", lateness).groupBy("rec").applyInPandasWithState(fuse, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_means(stream: DataFrame, width: str = "1 hour", hop: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Mean and number of observations per sliding event-time window and recording."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", width, hop), "rec").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n"))
