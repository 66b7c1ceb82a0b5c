"""Phase-loss rule, events as gaps and islands, latency, verdicts and speed segments."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import gradient, rms_track, runs

# Thresholds of the rule.
LOST, OFF, ROTATING, MIN_EVENT_S = 0.05, 0.05, 0.005, 0.5
FAULTS = ("phase_loss_running", "single_phasing_start")


def verdicts(df: DataFrame, width: int, hop: int, fs: float) -> DataFrame:
    """rec, w, t, r1, r2, r3, vib, rotating, lost, state per frame that all three currents have.

    The vibration track fills forward over its end; without one, the machine counts as rotating.
    """
    tracks = rms_track(df, width, hop, fs, ("rec", "channel"))
    pick = lambda ch: F.max(F.when(F.col("channel") == ch, F.col("rms")))
    wide = tracks.groupBy("rec", "w").agg(F.max("t").alias("t"), pick("I1").alias("r1"), pick("I2").alias("r2"), pick("I3").alias("r3"), pick("vib_x").alias("own_vib"))
    filled = F.last("own_vib", ignorenulls=True).over(Window.partitionBy("rec").orderBy("w"))
    wide = wide.withColumn("vib", filled).where("r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL").drop("own_vib")
    r = [F.col(f"r{k}") for k in (1, 2, 3)]
    others = lambda k: sum((x for j, x in enumerate(r) if j != k), F.lit(0.0)) / 2
    lost = F.array_compact(F.array(*[F.when(r[k] < LOST * others(k), F.lit(k)) for k in range(3)]))
    rotating = F.coalesce(F.col("vib") > ROTATING, F.lit(True))
    off = F.greatest(*r) < OFF
    state = F.when(off, "off").when(F.size("lost") == 0, "normal").when(F.col("rotating"), FAULTS[0]).otherwise(FAULTS[1])
    return wide.withColumn("rotating", rotating).withColumn("lost", F.when(off, F.array().cast("array<int>")).otherwise(lost)).withColumn("state", state)


def events(v: DataFrame, hop: int, fs: float, min_s: float = MIN_EVENT_S) -> DataFrame:
    """rec, run, state, w0, w1, t0, t1, phases, duration_s of fault runs; durations are compared in samples."""
    island = runs(v, "state", "w").where(F.col("state").isin(*FAULTS)).groupBy("rec", "run", "state")
    found = island.agg(F.min("w").alias("w0"), F.max("w").alias("w1"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lost")))).alias("phases"))
    return found.where((F.col("w1") - F.col("w0")) * hop >= min_s * fs).withColumn("duration_s", F.round(F.col("t1") - F.col("t0"), 3))


def recording_verdicts(v: DataFrame, found: DataFrame) -> DataFrame:
    severity = F.max(F.when(F.col("state") == FAULTS[1], 2).otherwise(1))
    worst = found.groupBy("rec").agg(severity.alias("s"))
    return v.select("rec").distinct().join(worst, "rec", "left").select("rec", F.when(F.col("s") == 2, FAULTS[1]).when(F.col("s") == 1, FAULTS[0]).otherwise("normal").alias("verdict"))


def detection_latency(v: DataFrame, found: DataFrame) -> DataFrame:
    """rec, phase, t_detected, t_truth, latency_s of each recording's first event.

    Truth is the first running frame below the midpoint of the phase's medians before and during the
    event; 0 latency where nothing ran before it.
    """
    first = found.groupBy("rec").agg(F.min_by(F.struct("t0", "t1", F.coalesce(F.get("phases", F.lit(0)), F.lit(0)).alias("phase")), "t0").alias("e")).select("rec", "e.*")
    series = F.get(F.array("r1", "r2", "r3"), F.col("phase"))
    rows = v.join(first, "rec").withColumn("s", series).withColumn("live", F.col("state") != "off")
    levels = rows.groupBy("rec").agg(F.median(F.when(F.col("live") & (F.col("t") < F.col("t0")), F.col("s"))).alias("high"), F.median(F.when(F.col("t").between(F.col("t0"), F.col("t1")), F.col("s"))).alias("low"))
    middle = (F.col("high") + F.col("low")) / 2
    crossing = rows.join(levels, "rec").groupBy("rec", "phase", "t0", "high").agg(F.min(F.when(F.col("live") & (F.col("s") < middle) & (F.col("t") <= F.col("t1")), F.col("t"))).alias("cross"))
    truth = F.when(F.col("high").isNull(), F.col("t0")).otherwise(F.coalesce("cross", "t0"))
    return crossing.select("rec", "phase", F.col("t0").alias("t_detected"), truth.alias("t_truth"), F.round(F.col("t0") - truth, 4).alias("latency_s"))


def segment_flags(track: DataFrame, limit: float = 2.0) -> DataFrame:
    """Adds slope and phase (accel, cruise, decel) to rows (rec, n, t, x)."""
    return gradient(track).withColumn("phase", F.when(F.col("slope") > limit, "accel").when(F.col("slope") < -limit, "decel").otherwise("cruise"))


def segments(track: DataFrame, limit: float = 2.0, min_s: float = 0.30) -> DataFrame:
    """rec, phase, t0, t1, f_mean, df_dt after short runs have joined their left, else right, neighbour.

    Joining restarts after each change, so it is one recording's own sequence, in one group.
    """

    def absorb(key, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("n")
        parts = []  # phase, first row, end row
        for i, phase in enumerate(d["phase"]):
            if parts and parts[-1][0] == phase:
                parts[-1][2] = i + 1
            else:
                parts.append([phase, i, i + 1])
        t, x, slope = (d[c].to_numpy() for c in ("t", "x", "slope"))
        while len(parts) > 1:
            short = next((k for k, (_, a, b) in enumerate(parts) if t[b - 1] - t[a] < min_s), None)
            if short is None:
                break
            parts[short][0] = parts[short - 1][0] if short else parts[1][0]
            merged = []
            for p in parts:
                if merged and merged[-1][0] == p[0]:
                    merged[-1][2] = p[2]
                else:
                    merged.append(p)
            parts = merged
        return pd.DataFrame([(key[0], p, t[a], t[b - 1], x[a:b].mean(), slope[a:b].mean()) for p, a, b in parts if len(d) > 1], columns=["rec", "phase", "t0", "t1", "f_mean", "df_dt"])

    return segment_flags(track, limit).groupBy("rec").applyInPandas(absorb, "rec long, phase string, t0 double, t1 double, f_mean double, df_dt double")


def cruise_mask(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds cruise: whether t lies in a cruise segment, ends included. Segments of a recording come as one array."""
    kept = parts.where("phase = 'cruise'").groupBy("rec").agg(F.collect_list(F.struct("t0", "t1")).alias("_c"))
    inside = F.exists(F.coalesce("_c", F.array().cast("array<struct<t0:double,t1:double>>")), lambda s: F.col("t").between(s["t0"], s["t1"]))
    return rows.join(kept, "rec", "left").withColumn("cruise", inside).drop("_c")


def gate(rows: DataFrame, parts: DataFrame, enabled: bool = False) -> DataFrame:
    """Rows in cruise if gating is on; all rows if it is off, as by default."""
    return cruise_mask(rows, parts).where("cruise").drop("cruise") if enabled else rows


def supply_features(v: DataFrame) -> DataFrame:
    """rec, w, state and eight numbers of each frame of verdicts(): RMS, RMS over the median phase, spread, vibration."""
    r = [F.col(f"r{k}") for k in (1, 2, 3)]
    middle = r[0] + r[1] + r[2] - F.greatest(*r) - F.least(*r)
    ratios = [F.when(middle > 0, x / middle).otherwise(0.0).alias(f"q{k}") for k, x in enumerate(r, 1)]
    return v.select("rec", "w", "state", "r1", "r2", "r3", *ratios, (F.least(*r) / F.greatest(F.greatest(*r), F.lit(1e-9))).alias("balance"), F.coalesce("vib", F.lit(0.0)).alias("vib"))


def recording_summaries(v: DataFrame, found: DataFrame) -> DataFrame:
    """rec, frames of each state, events, seconds in fault and the verdict, in one row a recording."""
    states = ("normal", "off", *FAULTS)
    counts = v.groupBy("rec").agg(F.count(F.lit(1)).alias("n_frames"), *[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in states])
    worst = found.groupBy("rec").agg(F.count(F.lit(1)).alias("n_events"), F.sum("duration_s").alias("fault_s"), F.max(F.when(F.col("state") == FAULTS[1], 2).otherwise(1)).alias("_s"))
    verdict = F.when(F.col("_s") == 2, FAULTS[1]).when(F.col("_s") == 1, FAULTS[0]).otherwise("normal")
    return counts.join(worst, "rec", "left").select(*counts.columns, F.coalesce("n_events", F.lit(0)).cast("long").alias("n_events"), F.coalesce("fault_s", F.lit(0.0)).alias("fault_s"), verdict.alias("verdict"))


def replayed(v: DataFrame) -> DataFrame:
    """rec, n, probs of verdicts() as a branch reports them: all on the state's class; off counts as normal."""
    at = [F.when(F.col("state").isin("normal", "off"), 1.0).otherwise(0.0), *[F.when(F.col("state") == s, 1.0).otherwise(0.0) for s in FAULTS]]
    return v.select("rec", F.lit(0).alias("epoch"), F.col("w").alias("n"), F.array(*at).alias("probs"))
