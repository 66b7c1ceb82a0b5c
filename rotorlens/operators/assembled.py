"""The feature cache's rows: a tensor for each window of each recording, failures beside them, and the report."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import assembly

COLUMNS = "file string, window long, x array<float>, rpm_est double, f_elec_hz double, speed_err double, error string"


def tensors(recordings: DataFrame, currents: tuple[str, str], vibration: str, speed: str | None, fs: float, **how) -> DataFrame:
    """COLUMNS of recordings (file, channel, x, error): x holds the channels of a window one after another.

    A recording is one group; one that lacks a channel, is too short or gives numbers that are not finite is one row
    with the reason in `error`, and stops no other.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        file = key[0]
        try:
            failed = d["error"].dropna()
            if len(failed):
                raise ValueError(failed.iloc[0])
            x = {c: np.asarray(v, float) for c, v in zip(d["channel"], d["x"])}
            missing = [c for c in (*currents, vibration) if c not in x]
            if missing:
                raise ValueError(f"missing channels {missing}")
            made, speeds = assembly.recording_tensor([x[c] for c in currents], x[vibration], fs, **how)
            if not len(made):
                raise ValueError("shorter than a window")
            if not np.isfinite(made).all():
                raise ValueError("numbers that are not finite")
            error = lambda s: assembly.speed_error(s["fr_hz"], x[speed]) if speed in x else float("nan")
            rows = [(file, k, t.ravel(), s["rpm"], s["f_elec_hz"], error(s), None) for k, (t, s) in enumerate(zip(made, speeds))]
        except ValueError as e:
            rows = [(file, None, None, None, None, None, f"{type(e).__name__}: {e}")]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"window": "Int64", "rpm_est": "Float64", "f_elec_hz": "Float64", "speed_err": "Float64"})

    return recordings.groupBy("file").applyInPandas(run, COLUMNS)


def report(cache: DataFrame, labels: DataFrame) -> DataFrame:
    """label, files, windows and the median and 99th percentile of the speed error; labels: file, label."""
    met = cache.where("error IS NULL").join(labels, "file")
    known = F.when(~F.isnan("speed_err"), F.col("speed_err"))
    return met.groupBy("label").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("windows"), F.median(known).alias("speed_err_median"), F.percentile(known, 0.99).alias("speed_err_p99"))
