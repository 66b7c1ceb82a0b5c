"""File-name grammars, text telemetry, prefix digests, pairing and settings fingerprints, as column expressions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bearing_names(files: DataFrame, name: str = "name") -> DataFrame:
    """condition, unit, run of names N.._M.._F.._<unit>_<run>.mat; others are left out."""
    grammar = r"^(N\d{2}_M\d{2}_F\d{2})_(K[A-Z]?\d+)_(\d+)\.mat$"
    part = lambda k: F.regexp_extract(name, grammar, k)
    return files.where(F.col(name).rlike(grammar)).withColumns({"condition": part(1), "unit": part(2), "run": part(3).cast("int")})


def winding_names(files: DataFrame, name: str = "name", strict: bool = True) -> DataFrame:
    """rating_w, severity_pct, modality, fault_type and label; a name that does not fit raises, or gives nulls."""
    grammar = r"^(\d+)W_(\d+[._]\d+)_(current|vibration)_(intercoil|interturn|coil)\.tdms$"
    fits = F.col(name).rlike(grammar)
    part = lambda k: F.when(fits, F.regexp_extract(name, grammar, k))
    rating = part(1).cast("int")
    if strict:
        rating = F.when(fits, rating).otherwise(F.raise_error(F.concat(F.lit("not a recording's name: "), F.col(name))).cast("int"))
    kind = F.when(part(4) == "coil", "intercoil").otherwise(part(4))
    out = files.withColumns({"rating_w": rating, "severity_pct": F.replace(part(2), F.lit("_"), F.lit(".")).cast("double"), "modality": part(3), "fault_type": kind})
    label = F.when(F.col("severity_pct") == 0, "healthy").when(F.col("fault_type") == "intercoil", "inter_coil").otherwise("inter_turn")
    return out.withColumn("label", label)


def pair_modalities(parsed: DataFrame, key: str) -> DataFrame:
    """One row per rating, severity and type with the key of each modality: a full outer join in one aggregate."""
    pick = lambda m: F.min(F.when(F.col("modality") == m, F.col(key)))
    return parsed.groupBy("rating_w", "severity_pct", "fault_type").agg(pick("current").alias("current_key"), pick("vibration").alias("vibration_key"))


def duplicates(files: DataFrame, key: str, content: str, prefix: int | None = None) -> DataFrame:
    """key, is_duplicate, duplicate_of: rows whose size in bytes and digest an earlier row has.

    The digest covers the whole content, or its first `prefix` bytes.
    """
    data = F.encode(F.coalesce(content, F.lit("")), "UTF-8")
    digest = files.select(key, F.md5(data if prefix is None else F.substring(data, 1, prefix)).alias("digest"), F.octet_length(data).alias("size"))
    w = Window.partitionBy("digest", "size").orderBy(key)
    placed = digest.withColumn("first", F.first(key).over(w)).withColumn("place", F.row_number().over(w))
    again = F.col("place") > 1
    return placed.select(key, again.alias("is_duplicate"), F.when(again, F.col("first")).alias("duplicate_of"))


def clock_lines(lines: DataFrame, line: str = "line", values: int = 8) -> DataFrame:
    """t_s (seconds of day) and v (short integers) of lines HH:MM:SS.mmm -> values; blank lines go, bad ones raise."""
    grammar = r"^(\d{2}):(\d{2}):(\d{2}\.\d{3}) -> (-?\d+(?: -?\d+){" + str(values - 1) + r"})\s*$"
    part = lambda k: F.regexp_extract(line, grammar, k)
    kept = lines.where(F.trim(line) != "")
    good = F.when(F.col(line).rlike(grammar), part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("double"))
    return kept.withColumns({"t_s": F.coalesce(good, F.raise_error(F.concat(F.lit("not a telemetry line: "), F.col(line))).cast("double")), "v": F.split(part(4), " ").cast("array<smallint>")})


def intervals(rows: DataFrame, key: str) -> DataFrame:
    """Median, least and largest seconds between neighbours in time."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    at = rows.select(key, "ts", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))
    gaps = at.select(key, ((F.col("u") - F.lag("u").over(w)) / 1e6).alias("g")).where("g IS NOT NULL")
    return gaps.groupBy(key).agg(F.median("g").alias("median_s"), F.min("g").alias("min_s"), F.max("g").alias("max_s"))


def daq_style(name: Column) -> Column:
    starts = lambda *p: F.lit(False) if not p else (name.startswith(p[0]) | starts(*p[1:]))
    return F.when(name.isNull() | (name == ""), "unknown").when(starts("Current_", "Normal_", "Vibration_"), "Current_<R>").when(name.rlike(r"^\d+(\.\d+)?kW_"), "kW_<R>ohm_current").when(name.rlike(r"^\d+(\.\d+)?kw_"), "kw_<R>ohm_current_<type>").otherwise("other")


def fingerprint(settings: dict) -> Column:
    """First 16 digits of the SHA-256 of the settings as sorted JSON."""
    return F.substring(F.sha2(F.lit(json.dumps(settings, sort_keys=True)), 256), 1, 16)
