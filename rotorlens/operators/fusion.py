"""Evidence fusion: authority, the hysteresis state machine in batch form, system status and evidence lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the state machine and the floor for fault authority.
POOL, TAU_FAULT, TAU_WARNING, HYSTERESIS, CONSECUTIVE = 10, 0.70, 0.45, 0.10, 3
MIN_GROUPS, MIN_MACRO_F1 = 3, 0.75
ORDER = ("Normal", "Warning", "Fault")
STAGE_OF = {"bearing": "S5", "winding": "S4", "supply": "S1", "inverter_telemetry": "S3"}


def authority(groups: Column, f1: Column) -> Column:
    return F.coalesce((groups >= MIN_GROUPS) & (f1 >= MIN_MACRO_F1), F.lit(False))


def tier(groups: Column, f1: Column) -> Column:
    return F.when(f1.isNull(), "NOT MEASURED").when(authority(groups, f1), "Fault-capable").otherwise("INDICATIVE")


def pooled(rows: DataFrame) -> DataFrame:
    """Adds p_fault, the mean of the last ten, and n_obs, to rows (rec, n, p)."""
    last = Window.partitionBy("rec").orderBy("n").rowsBetween(-(POOL - 1), 0)
    return rows.withColumn("p_fault", F.avg("p").over(last)).withColumn("n_obs", F.count(F.lit(1)).over(last))


def _statuses(ready: DataFrame, keys: list[str]) -> DataFrame:
    """Adds status to rows (*keys, n, p_fault, may) by windows alone: no row's history is ever held together.

    A run counter reaches K where the last K observations, and none fewer, meet its level. Fault is left by clearing
    alone, and Warning by Fault or clearing, so the last place of each deciding observation tells the status.
    """
    so_far = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy(*keys).orderBy("n").rowsBetween(-(CONSECUTIVE - 1), 0)
    held = lambda on: (F.min(on.cast("int")).over(last) == 1) & (F.count(F.lit(1)).over(last) == CONSECUTIVE)
    p = F.col("p_fault")
    fault, warn, clear = held(p >= TAU_FAULT) & F.col("may"), held(p >= TAU_WARNING), held(p < TAU_WARNING - HYSTERESIS)
    at = ready.withColumns({"_f": F.when(fault, F.col("n")), "_w": F.when(warn, F.col("n")), "_c": F.when(clear, F.col("n"))})
    seen = at.withColumns({c: F.coalesce(F.max(c).over(so_far), F.lit(-1)) for c in ("_f", "_w", "_c")})
    status = F.when(F.col("_f") > F.col("_c"), "Fault").when(F.col("_w") > F.col("_c"), "Warning").otherwise("Normal")
    return seen.withColumn("status", status).drop("_f", "_w", "_c")


def trace(rows: DataFrame, may_fault: Column) -> DataFrame:
    """rec, n, p_fault, status after each observation of rows (rec, n, p)."""
    return _statuses(pooled(rows).withColumn("may", may_fault), ["rec"]).select("rec", "n", "p_fault", "status")


def evaluate(rows: DataFrame, labels: list[str], may_fault: Column, faults: list[str] | None = None) -> DataFrame:
    """What each observation of rows (rec, epoch, n, probs) leaves its branch in; probs has one entry a label.

    The pool and the run counters start anew with each epoch, which is what a reset does; n_obs_total goes on.
    faults: labels that count as faulty, by default all but healthy and normal. A wrong number of entries raises.
    """
    faults = [x for x in labels if x not in ("healthy", "normal")] if faults is None else faults
    text = F.concat(F.lit(f"expected {len(labels)} probabilities, got "), F.size("probs").cast("string"))
    checked = rows.withColumn("probs", F.when(F.size("probs") == len(labels), F.col("probs")).otherwise(F.raise_error(text).cast("array<double>")))
    last = Window.partitionBy("rec", "epoch").orderBy("n").rowsBetween(-(POOL - 1), 0)
    total = Window.partitionBy("rec").orderBy("epoch", "n").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.array(*[F.avg(F.get("probs", F.lit(k))).over(last) for k in range(len(labels))])
    ready = checked.withColumns({"mean": mean, "n_obs": F.count(F.lit(1)).over(last), "n_obs_total": F.count(F.lit(1)).over(total), "may": may_fault})
    hit = [F.get("mean", F.lit(k)) for k, x in enumerate(labels) if x in faults]
    ready = ready.withColumn("p_fault", sum(hit[1:], hit[0]) if hit else F.lit(0.0))
    names = F.array(*[F.lit(x) for x in labels])
    top = F.get(names, F.array_position("mean", F.array_max("mean")).cast("int") - 1)
    out = _statuses(ready, ["rec", "epoch"])
    return out.select("rec", "epoch", "n", "status", "p_fault", top.alias("top_class"), F.array_max("mean").alias("confidence"), "n_obs", "n_obs_total", F.col("may").alias("fault_authority"))


def final_status(traced: DataFrame) -> DataFrame:
    return traced.groupBy("rec").agg(F.max_by("status", "n").alias("status"), F.count(F.lit(1)).alias("n_obs_total"))


def rank_of(status: Column) -> Column:
    """Place in the order; an unknown status is worse than all."""
    place = F.array_position(F.array(*[F.lit(s) for s in ORDER]), status)
    return F.when(place > 0, place - 1).otherwise(len(ORDER)).cast("int")


def system_status(views: DataFrame, key: str, by: list[str]) -> DataFrame:
    """Worst status of each group and the first member, in key order, that has it."""
    best = F.max_by(F.struct("status", F.col(key).alias("driver")), F.struct(rank_of(F.col("status")), -F.col(key)))
    return views.groupBy(*by).agg(best.alias("b")).select(*by, "b.status", "b.driver")


def evidence(status: Column, stage: Column, name: Column, confidence: Column, n_obs: Column, metric: Column, may: Column) -> Column:
    head = F.concat_ws(" · ", F.upper(status), F.concat_ws(" ", stage, name), F.concat(F.rint(confidence * 100).cast("int").cast("string"), F.lit("%")), F.concat(n_obs.cast("string"), F.lit(" pooled obs")))
    text = F.when(metric.isNull(), "branch NOT MEASURED").otherwise(F.concat(F.lit("branch macro-F1 "), F.format_number(metric, 2)))
    return F.concat_ws(" · ", head, text, F.when(~may, "LOW CONFIDENCE BRANCH"))


def authority_table(metrics: DataFrame) -> DataFrame:
    """Tests of the floor per branch; null where nothing was measured. metrics: branch, groups, f1."""
    return metrics.select("branch", "groups", "f1", F.when(F.col("f1").isNotNull(), F.col("groups") >= MIN_GROUPS).alias("groups_test"), F.when(F.col("f1").isNotNull(), F.col("f1") >= MIN_MACRO_F1).alias("metric_test"), tier(F.col("groups"), F.col("f1")).alias("tier"), authority(F.col("groups"), F.col("f1")).alias("fault_authority"))


def number(value: Column, digits: int = 4) -> Column:
    """A dash for null, NaN by name, else with `digits` decimals."""
    return F.when(value.isNull(), "\u2014").when(F.isnan(value), "NaN").otherwise(F.format_string(f"%.{digits}f", value.cast("double")))


def describe_metric(metrics: DataFrame) -> DataFrame:
    """branch and one line on its metric. metrics: branch, groups, f1, protocol, metric_name."""
    line = F.when(F.col("f1").isNull(), "not measured").otherwise(F.concat_ws(" \u00b7 ", F.concat_ws(" ", "metric_name", number(F.col("f1"))), F.col("protocol"), F.concat(F.col("groups").cast("string"), F.lit(" groups"))))
    return metrics.select("branch", line.alias("line"))


def stage_rows(stages: DataFrame, metrics: DataFrame, statuses: DataFrame) -> DataFrame:
    """One row a stage, measured or not. stages: stage, branch; metrics as in describe_metric; statuses: branch, status."""
    met = stages.join(metrics, "branch", "left").join(statuses, "branch", "left")
    measured, may = F.col("f1").isNotNull(), authority(F.col("groups"), F.col("f1"))
    named = tier(F.col("groups"), F.col("f1"))
    line = F.when(measured, F.concat_ws(" \u00b7 ", F.concat_ws(" ", "metric_name", number(F.col("f1"))), F.col("protocol"), F.concat(F.col("groups").cast("string"), F.lit(" groups")))).otherwise("no results")
    shown = F.coalesce("status", F.when(measured, "Normal").otherwise("NOT MEASURED"))
    return met.select("stage", "branch", named.alias("tier"), shown.alias("status"), line.alias("metric_line"), may.alias("can_fault"), measured.alias("measured"))


def metric_cards(metrics: DataFrame) -> DataFrame:
    """One card a branch with its figure and the floors it is held against."""
    return metrics.select("branch", tier(F.col("groups"), F.col("f1")).alias("tier"), F.col("f1").isNotNull().alias("measured"), F.when(F.col("f1").isNotNull(), number(F.col("f1"))).alias("metric"), "metric_name", "protocol", "groups", F.lit(MIN_GROUPS).alias("groups_floor"), F.lit(MIN_MACRO_F1).alias("metric_floor"))
