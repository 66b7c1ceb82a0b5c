"""Spectra of frames, order axes, conditioning; long-window kernels are in functions.kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-12


def magnitudes(rows: DataFrame, array: str, size: int, key: str = "rec") -> DataFrame:
    """rec, bin, mag of the one-sided transform of an array column of fixed size (2/n scaled).

    Arrays cross to Python in Arrow batches for a fast transform: a sum for each bin would be quadratic in size.
    """

    @F.pandas_udf("array<double>")
    def transformed(arrays: pd.Series) -> pd.Series:
        x = np.stack(arrays.to_numpy()).astype(float) if len(arrays) else np.zeros((0, size))
        return pd.Series(list(np.abs(np.fft.rfft(x, axis=1)) * (2.0 / size)))

    whole = rows.where(F.size(array) == size)
    return whole.select(key, F.posexplode(transformed(F.col(array))).alias("bin", "mag"))


def parabolic_peak(spectrum: DataFrame, low: int, high: int, key: str = "rec") -> DataFrame:
    """Largest bin in [low, high] (the first on ties) and its vertex by three points, moved by half a bin at most."""
    w = Window.partitionBy(key).orderBy("bin")
    near = spectrum.withColumn("left", F.lag("mag").over(w)).withColumn("right", F.lead("mag").over(w)).where(F.col("bin").between(low, high))
    best = near.groupBy(key).agg(F.min_by(F.struct("bin", "left", "mag", "right"), F.struct(-F.col("mag"), "bin")).alias("p"))
    a, b, c = F.col("p.left"), F.col("p.mag"), F.col("p.right")
    bend = a - 2 * b + c
    shift = F.when(F.abs(bend) > EPSILON, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (a - c) / bend))).otherwise(0.0)
    return best.select(key, F.col("p.bin").alias("peak_bin"), (F.col("p.bin") + F.coalesce(shift, F.lit(0.0))).alias("peak"))


def gathered(array: Column, position: Column, last: int) -> Column:
    """Linear interpolation of an array at a fractional place; 0 outside [0, last]."""
    i = F.floor(position).cast("int")
    at = lambda k: F.get(array, k)
    inner = at(i) + (position - i) * (F.coalesce(at(i + 1), at(i)) - at(i))
    return F.when((position >= 0) & (position <= last), inner).otherwise(0.0)


def order_interp(spectra: DataFrame, array: str, step: Column, n_orders: int, last: int) -> DataFrame:
    """rec, k, v: the spectrum read at k * step bins for k = 1..n_orders."""
    return spectra.select("rec", F.col(array).alias("_a"), step.alias("_s"), F.explode(F.sequence(F.lit(1), F.lit(n_orders))).alias("k")).select("rec", "k", gathered(F.col("_a"), F.col("k") * F.col("_s"), last).alias("v"))


def sideband_fold(spectra: DataFrame, array: str, supply: int, step: Column, n_orders: int, last: int, harmonics: int = 8, notch: float = 0.4) -> DataFrame:
    """rec, k, v: upper plus lower sideband around the supply bin, over the fundamental.

    Bins within `notch` of a supply harmonic are 0; the fundamental is read before that.
    """
    notched = F.transform(array, lambda x, i: F.when(F.exists(F.sequence(F.lit(1), F.lit(harmonics)), lambda h: (F.abs(i - h * supply) <= notch) & (h * supply <= last)), 0.0).otherwise(x))
    rows = spectra.select("rec", F.get(F.col(array), F.lit(supply)).alias("_f"), notched.alias("_a"), step.alias("_s"), F.explode(F.sequence(F.lit(1), F.lit(n_orders))).alias("k"))
    up, down = gathered(F.col("_a"), supply + F.col("k") * F.col("_s"), last), gathered(F.col("_a"), F.abs(supply - F.col("k") * F.col("_s")), last)
    return rows.select("rec", "k", F.when(F.col("_f") > EPSILON, (up + down) / F.col("_f")).otherwise(0.0).alias("v"))


def log_band_energy(spectrum: DataFrame, low: float, high: float, n_bands: int, key: str = "rec") -> DataFrame:
    """rec, band, v: square root of the power between logarithmic edges, half-open; no range join.

    A bin's band is computed from its own frequency, and empty bands come from the array of all bands.
    """
    edges = [low * (high / low) ** (i / n_bands) for i in range(n_bands + 1)]
    band = F.lit(0)
    for e in edges[1:-1]:
        band = band + F.when(F.col("bin") >= e, 1).otherwise(0)
    inside = spectrum.where((F.col("bin") >= edges[0]) & (F.col("bin") < edges[-1])).withColumn("band", band)
    power = inside.groupBy(key, "band").agg(F.sum(F.col("mag") * F.col("mag")).alias("p"))
    every = power.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("band", "p"))).alias("m"))
    return every.select(key, "m", F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1))).alias("band")).select(key, "band", F.sqrt(F.coalesce(F.try_element_at("m", F.col("band")), F.lit(0.0))).alias("v"))


def condition(spectrum: DataFrame, value: str = "mag", key: str = "rec") -> DataFrame:
    """log1p of the spectrum over its median; over its mean, or 1, where the median is next to nothing."""
    whole = Window.partitionBy(key)
    typical = spectrum.withColumns({"_m": F.median(value).over(whole), "_a": F.avg(F.abs(value)).over(whole)})
    scale = F.when(F.col("_m") > EPSILON, F.col("_m")).when(F.col("_a") > EPSILON, F.col("_a")).otherwise(1.0)
    return typical.withColumn("v", F.log1p(F.col(value) / (scale + EPSILON))).drop("_m", "_a")


def order_bands(magnitude: DataFrame, key: str = "rec") -> DataFrame:
    """log1p of mean order amplitudes over max(median, 1e-6 of the peak)."""
    whole = Window.partitionBy(key)
    typical = magnitude.withColumns({"_m": F.median("mag").over(whole), "_p": F.max("mag").over(whole)})
    scale = F.greatest(F.col("_m"), 1e-6 * F.col("_p"))
    return typical.withColumn("band", F.when(scale > 0, F.log1p(F.col("mag") / scale)).otherwise(0.0)).drop("_m", "_p")
