"""Framing, alignment and windowed statistics on long-format samples (rec, n, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def samples(seconds: float, fs: float) -> int:
    """Seconds to samples, half to even."""
    return int(round(seconds * fs))


def frame_counts(df: DataFrame, width: int, hop: int, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Number of whole frames of each recording; short recordings have none."""
    if width <= 0 or hop <= 0:
        raise ValueError("a frame and its hop need at least one sample")
    size = F.count(F.lit(1))
    return df.groupBy(*keys).agg(size.cast("long").alias("n_samples"), F.when(size >= width, F.floor((size - width) / hop) + 1).otherwise(0).cast("long").alias("n_frames"))


def frames(df: DataFrame, width: int, hop: int, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Each sample once per frame that holds it: adds w (frame) and k (place in the frame); whole frames only."""
    if width <= 0 or hop <= 0:
        raise ValueError("a frame and its hop need at least one sample")
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    first = F.greatest(F.lit(0), F.ceil((F.col("n") - (width - 1)) / hop)).cast("long")
    dealt = df.withColumn("_len", size).withColumn("w", F.explode(F.sequence(first, F.floor(F.col("n") / hop).cast("long"), F.lit(1).cast("long"))))
    return dealt.where(F.col("w") * hop + width <= F.col("_len")).withColumn("k", F.col("n") - F.col("w") * hop).drop("_len")


def frame_stats(framed: DataFrame, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Mean, population deviation, extremes and RMS of each frame."""
    return framed.groupBy(*keys, "w").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def rms_track(df: DataFrame, width: int, hop: int, fs: float, keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """w, t (seconds at the frame's middle) and rms."""
    return frames(df, width, hop, keys).groupBy(*keys, "w").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms")).withColumn("t", (F.col("w") * hop + width / 2) / fs)


def telemetry_features(framed: DataFrame, width: int, fs: float) -> DataFrame:
    """Features of frames with two currents a, b and three ADC channels t1, t2, t3."""
    by = framed.groupBy("rec", "w")
    stats = [f(c).alias(f"{c}_{name}") for c in ("a", "b", "t1", "t2", "t3") for name, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    rate = lambda c: (F.max_by(c, "k") - F.min_by(c, "k")) / (width / fs)
    agg = by.agg(*stats, *[rate(c).alias(f"{c}_rate") for c in ("t1", "t2", "t3")])
    half = (F.abs("a_mean") + F.abs("b_mean")) / 2
    means = [F.col(f"t{i}_mean") for i in (1, 2, 3)]
    rates = [F.col(f"t{i}_rate") for i in (1, 2, 3)]
    return agg.select(
        "*",
        F.when(half > 1e-9, (F.col("a_mean") - F.col("b_mean")) / half).otherwise(0.0).alias("imbalance"),
        F.abs(F.col("a_mean") - F.col("b_mean")).alias("current_diff"),
        (means[0] - means[1]).alias("d12"), (means[0] - means[2]).alias("d13"), (means[1] - means[2]).alias("d23"),
        (F.greatest(*means) - F.least(*means)).alias("spread"), F.least(*rates).alias("rate_min"), F.greatest(*rates).alias("rate_max"),
    )


def align_shortest(df: DataFrame) -> DataFrame:
    """Samples of (rec, channel, n, x) that every channel of the recording has."""
    # The longest place each channel reaches is its size less one: no count and no join back is needed.
    by_channel, by_rec = Window.partitionBy("rec", "channel"), Window.partitionBy("rec")
    sized = df.withColumn("_size", F.max("n").over(by_channel))
    return sized.withColumn("_shortest", F.min("_size").over(by_rec)).where(F.col("n") <= F.col("_shortest")).drop("_size", "_shortest")


def durations(df: DataFrame, fs: float) -> DataFrame:
    """Seconds that all channels of a recording share."""
    return df.groupBy("rec", "channel").agg(F.count(F.lit(1)).alias("size")).groupBy("rec").agg((F.min("size") / fs).alias("duration"))


def summaries(df: DataFrame, fs: float) -> DataFrame:
    """One line of text per recording: its channels, rates and sizes."""
    sizes = df.groupBy("rec", "channel").agg(F.count(F.lit(1)).alias("size"))
    part = F.concat(F.col("channel"), F.lit(f"@{fs:g}Hz x"), F.col("size").cast("string"))
    return sizes.groupBy("rec").agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(part)), ", "), F.lit("]")).alias("summary"))


def violations(df: DataFrame, stages: tuple[str, ...], channels: tuple[str, ...]) -> DataFrame:
    """Recordings that break a rule of the model, each with the names of the rules."""
    rules = {"stage": ~F.col("stage").isin(*stages), "group": F.coalesce(F.trim("grp") == "", F.lit(True)), "rate": ~(F.coalesce("fs", F.lit(0.0)) > 0), "channel": ~F.col("channel").isin(*channels)}
    broken = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def median_filter(df: DataFrame, taps: int = 5, value: str = "x") -> DataFrame:
    """Running median with repeated edges; recordings shorter than the filter stay as they are.

    The edges repeat, so a plain frame of rows is not enough: each sample is sent to the places whose
    window holds it, as often as clamping the window's ends would take it.
    """
    half = taps // 2
    size = F.count(F.lit(1)).over(Window.partitionBy("rec"))
    by_place = Window.partitionBy("rec").orderBy("n")
    near = [F.coalesce(F.lag(value, d).over(by_place), F.first(value).over(by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) for d in range(half, 0, -1)]
    near += [F.col(value)]
    near += [F.coalesce(F.lead(value, d).over(by_place), F.last(value).over(by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) for d in range(1, half + 1)]
    return df.withColumn("_size", size).withColumn("smooth", F.when(F.col("_size") < taps, F.col(value)).otherwise(F.get(F.array_sort(F.array(*near)), F.lit(half)))).drop("_size")


def runs(df: DataFrame, flag: str, order: str = "n", keys: tuple[str, ...] = ("rec",)) -> DataFrame:
    """Adds run: the number of the maximal stretch of equal flags, from 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)), 0).otherwise(1)
    return df.withColumn("_changed", changed).withColumn("run", F.sum("_changed").over(w)).drop("_changed")


def gradient(df: DataFrame, t: str = "t", value: str = "x") -> DataFrame:
    """Adds slope: second-order central differences on uneven times, one-sided at both ends."""
    w = Window.partitionBy("rec").orderBy("n")
    before, after = F.col(t) - F.lag(t).over(w), F.lead(t).over(w) - F.col(t)
    low, high = F.lag(value).over(w), F.lead(value).over(w)
    inner = (before * before * high + (after * after - before * before) * F.col(value) - after * after * low) / (before * after * (before + after))
    ends = F.when(before.isNull(), (high - F.col(value)) / after).when(after.isNull(), (F.col(value) - low) / before)
    return df.withColumn("slope", F.coalesce(ends, inner))


def first_largest(values: Column) -> Column:
    """Place (from 0) of the largest entry; the first one if several are."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
