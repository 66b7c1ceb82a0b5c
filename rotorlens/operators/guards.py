"""Checks that raise where a table breaks a rule, and reports on what an index holds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames

# Units whose damage was made on purpose.
ARTIFICIAL = "KA01 KA03 KA05 KA06 KA07 KA08 KA09 KI01 KI03 KI05 KI07 KI08".split()


def _guard(column: Column, holds: Column, message: Column, kind: str) -> Column:
    return F.when(holds, column).otherwise(F.raise_error(message).cast(kind))


def channels(samples: DataFrame, required: list[str], optional: tuple[str, ...] = ()) -> DataFrame:
    """Samples (rec, channel, n, x) of the channels asked for; a recording that lacks a required one raises with what it has."""
    have = F.array_sort(F.collect_set("channel").over(Window.partitionBy("rec")))
    lacks = F.array_except(F.array(*[F.lit(c) for c in required]), "_have")
    text = F.concat(F.lit("channels ["), F.array_join(lacks, ", "), F.lit("] are missing; there are ["), F.array_join("_have", ", "), F.lit("]"))
    checked = samples.withColumn("_have", have).withColumn("channel", _guard(F.col("channel"), F.size(lacks) == 0, text, "string"))
    return checked.where(F.col("channel").isin([*required, *optional])).drop("_have")


def aligned(samples: DataFrame) -> DataFrame:
    """Samples (rec, channel, fs, n, x) cut to each recording's shortest channel; channels of unlike rates raise."""
    by_rec = Window.partitionBy("rec")
    same = F.min("fs").over(by_rec) == F.max("fs").over(by_rec)
    text = F.concat(F.lit("unlike rates in recording "), F.col("rec").cast("string"))
    return frames.align_shortest(samples.withColumn("_same", same).withColumn("fs", _guard(F.col("fs"), F.col("_same"), text, "double")).drop("_same"))


def overridden(recordings: DataFrame, stages: tuple[str, ...], known: tuple[str, ...], **values) -> DataFrame:
    """recordings (rec, stage, grp, fs, channel) with some columns replaced, checked anew; a broken rule raises by name."""
    changed = recordings.withColumns({k: F.lit(v) for k, v in values.items()})
    broken = frames.violations(changed, stages, known).select(F.col("rec").alias("_rec"), "broken")
    text = F.concat(F.lit("recording "), F.col("rec").cast("string"), F.lit(" breaks: "), F.array_join("broken", ", "))
    met = changed.join(broken.dropDuplicates(["_rec"]), F.col("rec").eqNullSafe(F.col("_rec")), "left")
    return met.withColumn("stage", _guard(F.col("stage"), F.col("broken").isNull(), text, "string")).drop("_rec", "broken")


def damage_origin(unit: Column, label: Column) -> Column:
    return F.when(label == "healthy", "none").when(unit.isin(ARTIFICIAL), "artificial").otherwise("real")


def ratios_only(features: DataFrame, absolute: list[str]) -> DataFrame:
    """features, or an error if one of its columns is an absolute amplitude, which no two files share a scale for."""
    wrong = sorted(set(features.columns) & set(absolute))
    if wrong:
        raise ValueError(f"{wrong}: amplitudes without a common scale; use ratios")
    return features


def out_of_sample(scenarios: DataFrame, branch: str) -> DataFrame:
    """Scenarios (scenario, branch, unit, out_of_sample, trained_on); one of `branch` that may replay what was learnt raises."""
    own = F.col("branch") == branch
    unmarked = own & ~F.coalesce("out_of_sample", F.lit(False))
    learnt = own & F.coalesce(F.array_contains("trained_on", F.col("unit")), F.lit(False))
    text = F.concat(F.col("scenario"), F.when(unmarked, ": not marked out of sample").otherwise(F.concat(F.lit(": trained on "), F.col("unit"))))
    return scenarios.withColumn("scenario", _guard(F.col("scenario"), ~(unmarked | learnt), text, "string"))


def index_report(index: DataFrame, runs: int) -> DataFrame:
    """kind, name, n, odd of an index (unit, label, origin): rows by label, by origin and by unit, whose runs should be `runs`."""
    part = lambda kind: index.groupBy(F.col(kind).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n", (F.lit(kind == "unit") & (F.col("n") != runs)).alias("odd"))
    return reduce(DataFrame.unionByName, [part(k) for k in ("label", "origin", "unit")])


def expected_count(index: DataFrame, expected: int) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("found")).select("found", F.lit(expected).cast("long").alias("expected"), (F.col("found") == expected).alias("ok"))


def paired_and_deduplicated(parsed: DataFrame) -> DataFrame:
    """One row per rating, type and severity of parsed names (rating_w, fault_type, severity_pct, label, modality, name,
    size, digest), with both modalities' names; of a rating's two healthy rows the second is the first's duplicate.

    A rating without exactly two healthy rows, or whose two differ in size or digest, raises.
    """
    pick = lambda m, c: F.min(F.when(F.col("modality") == m, F.col(c)))
    key = ["rating_w", "fault_type", "severity_pct"]
    rows = parsed.groupBy(*key).agg(F.min("label").alias("label"), pick("current", "name").alias("current_file"), pick("vibration", "name").alias("vibration_file"), pick("current", "size").alias("size"), pick("current", "digest").alias("digest"))
    healthy = F.col("severity_pct") == 0
    by = Window.partitionBy("rating_w", healthy)
    seen = rows.withColumns({"_place": F.row_number().over(by.orderBy("fault_type")), "_n": F.count(F.lit(1)).over(by), "_same": (F.min("size").over(by) == F.max("size").over(by)) & (F.min("digest").over(by) == F.max("digest").over(by)), "_first": F.first("current_file").over(by.orderBy("fault_type"))})
    text = F.when(F.col("_n") != 2, "two healthy rows are expected of each rating").otherwise("the healthy files of a rating differ")
    sound = ~healthy | ((F.col("_n") == 2) & F.coalesce("_same", F.lit(False)))
    again = healthy & (F.col("_place") == 2)
    return seen.withColumn("label", _guard(F.col("label"), sound, F.concat(F.col("rating_w").cast("string"), F.lit("W: "), text), "string")).select(*key, "label", "current_file", "vibration_file", again.alias("is_duplicate"), F.when(again, F.col("_first")).alias("duplicate_of"))
