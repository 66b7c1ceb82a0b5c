"""Protocol runners: fold tables, a learner per fold in its own task, scores with exclusions and their reasons.

A feature table is (row, x array<double>, columns that group or label). Every fold of a table of up to IN_TASK numbers is
one group of the plan, whose task holds the rows that train and test it. Boosted trees of a larger table are grown for all
folds at once by tasks that hold a batch of rows each (spread.py). Other learners hold a fold in a task; for these,
`most_rows` raises beyond what a task may hold and drops nothing. Rows are dealt to folds through an array of (fold, role),
not through a join.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boosting import BoostedClassifier, standardised
from . import metrics, splits, spread

MOST_ROWS = 2_000_000
#: Values of x in a table whose folds are learnt in a task each; a task takes up to about 120 bytes for each.
IN_TASK = 2_000_000


def boosted(rounds: int = 200, rate: float = 0.06, depth: int = 4, least: int = 20) -> Callable:
    """Standardise on the training rows alone, fit, predict."""

    def run(x: np.ndarray, y: np.ndarray, tests: np.ndarray) -> np.ndarray:
        x, tests = standardised(x, tests)
        return BoostedClassifier(rounds, rate, depth, least=least).fit(x, y).predict(tests)

    run.spread = lambda rows, n, width: spread.predictions(rows, n, width, rounds, rate, depth, least)
    return run


def group_roles(group: str, held: list, tested: Column | None = None) -> Column:
    """(fold, role) of a row for leave-one-group-out: it tests in its own group's fold and trains in all others.

    tested: rows for which it is false train, and test nowhere.
    """
    every = F.array(*[F.struct(F.lit(k).cast("long").alias("fold"), F.when(F.col(group) == h, "test").otherwise("train").alias("role")) for k, h in enumerate(held)])
    return every if tested is None else F.filter(every, lambda r: (r["role"] == "train") | tested)


def shuffled_roles(rows: DataFrame, folds: int, seed: int, strata: list[str] | None = None) -> DataFrame:
    """rows with roles of the leaky reference: random folds over windows, whatever they belong to."""
    place = splits.shuffled(rows, folds, seed, "row", strata).select("row", F.col("fold").alias("_own"))
    every = F.array(*[F.struct(F.lit(k).cast("long").alias("fold"), F.when(F.col("_own") == k, "test").otherwise("train").alias("role")) for k in range(folds)])
    return rows.join(place, "row").withColumn("roles", every).drop("_own")


def block_roles(rows: DataFrame, share: float, purge: int, order: list[str], group: list[str] | None = None) -> DataFrame:
    """rows with the roles of one fold: the first part of each group trains, the last tests, what lies between is purged."""
    role = splits.contiguous_block(rows.select("row", *order, *(group or [])), share, purge, "row", order, group).select("row", "role")
    return rows.join(role.where("role <> 'purged'"), "row").withColumn("roles", F.array(F.struct(F.lit(0).cast("long").alias("fold"), "role"))).drop("role")


def predictions(rows: DataFrame, label: str, learner: Callable, most_rows: int = MOST_ROWS) -> DataFrame:
    """fold, row, truth, pred (strings) of every test row; rows: row, x, roles and the label column.

    A fold whose training rows have one class alone, or whose test rows are none, gives no predictions.
    """

    def run(key, d: pd.DataFrame) -> pd.DataFrame:
        if len(d) > most_rows:
            raise ValueError(f"fold {key[0]} has {len(d)} rows; one task may hold {most_rows}")
        d = d.sort_values("row", kind="stable")  # the order of arrival must not show in what is learnt
        train, test = d[d["role"] == "train"], d[d["role"] == "test"]
        if not len(test) or train["truth"].nunique() < 2:
            none, no = np.zeros(0, np.int64), np.zeros(0, object)
            return pd.DataFrame({"fold": none, "row": none, "truth": no, "pred": no})
        pred = learner(np.stack(train["x"]).astype(float), train["truth"].to_numpy(), np.stack(test["x"]).astype(float))
        return pd.DataFrame({"fold": key[0], "row": test["row"].to_numpy(), "truth": test["truth"].to_numpy(object), "pred": pred})

    plain = rows.select("row", F.col("x").cast("array<double>").alias("x"), F.col(label).cast("string").alias("truth"), "roles")
    if hasattr(learner, "spread"):
        size = plain.where(F.size("roles") > 0).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).first()
        if size["n"] * (size["width"] or 0) > IN_TASK:
            return learner.spread(plain.where(F.size("roles") > 0), size["n"], size["width"])
    dealt = plain.select("row", "x", "truth", F.explode("roles").alias("r")).select("r.fold", "r.role", "row", "x", "truth")
    return dealt.groupBy("fold").applyInPandas(run, "fold long, row long, truth string, pred string")


def _scored(found: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    """n, accuracy, macro_f1 and majority_baseline of (truth, pred) rows with string labels."""
    place = lambda c: (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(c)) - 1).cast("int")
    coded = found.select(*by, place("truth").alias("truth"), place("pred").alias("pred"))
    whole = metrics.scores(coded, list(range(len(labels))), by)
    base = metrics.majority_baseline(coded, by).withColumnRenamed("baseline", "majority_baseline")
    return whole.join(base, by) if by else whole.join(F.broadcast(base))


def grouped(rows: DataFrame, group: str, label: str, labels: list[str], learner: Callable, excluded: list | None = None, made: tuple[list, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Leave-one-group-out: scores per fold, with those left out of scoring and why, and scores of all test rows pooled.

    Excluded groups still train. A fold that tests one class alone is not scored. made: the groups that are held out, and
    predictions() of all rows by group_roles() of these, where the caller has them.
    """
    held = made[0] if made else [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]  # one value a group
    kept = ~F.col(group).isin(excluded) if excluded else F.lit(True)
    seen = rows.groupBy(F.col(group).alias("held_out")).agg(F.count(F.lit(1)).alias("n_test"), F.array_sort(F.collect_set(F.col(label).cast("string"))).alias("classes"))
    fold = F.array_position(F.array(*[F.lit(h) for h in held]), F.col("held_out")) - 1
    out = F.col("held_out").isin(excluded) if excluded else F.lit(False)
    reason = F.when(out, "group excluded from scoring").when(F.size("classes") < 2, F.concat(F.lit("test set has one class only: "), F.array_join("classes", ", ")))
    plan = seen.select(fold.alias("fold"), "held_out", "n_test", reason.alias("reason"))
    single = [r["held_out"] for r in plan.where("reason IS NOT NULL").select("held_out").collect()]
    if made:
        left = [k for k, h in enumerate(held) if h in {*single, *(excluded or [])}]
        found = made[1].where(~F.col("fold").isin(left)) if left else made[1]
    else:
        tested = kept & ~F.col(group).isin(single) if single else kept
        found = predictions(rows.withColumn("roles", group_roles(group, held, tested)), label, learner)
    folds = plan.join(_scored(found, labels, ["fold"]).drop("n"), "fold", "left")
    return folds, _scored(found, labels, [])


def shuffled(rows: DataFrame, label: str, labels: list[str], learner: Callable, folds: int = 5, seed: int = 0) -> DataFrame:
    return _scored(predictions(shuffled_roles(rows, folds, seed, [label]), label, learner), labels, [])


def batch_control(rows: DataFrame, group: str, targets: dict[str, list[str]], learner: Callable, folds: int = 5, seed: int = 0) -> DataFrame:
    """target, leaky, scores: how well the same features tell where and when a row was taken, by group and at random."""
    held = [r[0] for r in rows.select(group).distinct().orderBy(group).collect()]
    out = None
    for target, labels in targets.items():
        by_group = _scored(predictions(rows.withColumn("roles", group_roles(group, held)), target, learner), labels, [])
        for leaky, found in ((False, by_group), (True, shuffled(rows, target, labels, learner, folds, seed))):
            part = found.select(F.lit(target).alias("target"), F.lit(leaky).alias("leaky"), "*")
            out = part if out is None else out.unionByName(part)
    return out


def block(rows: DataFrame, label: str, labels: list[str], learner: Callable, share: float = 0.7, purge: int = 5, order: tuple[str, ...] = ("position",), group: tuple[str, ...] = ("run",)) -> DataFrame:
    return _scored(predictions(block_roles(rows, share, purge, list(order), list(group)), label, learner), labels, [])


def relabelled(rows: DataFrame, label: str, healthy: str, name: str = "label") -> DataFrame:
    """The binary task: healthy against the rest."""
    return rows.withColumn(name, F.when(F.col(label) == healthy, "healthy").otherwise("damaged"))


def calibration_roles(rows: DataFrame, key: str, calibration: int, verification: int, seed: int) -> DataFrame:
    """key, role of two disjoint sets of rows by one seeded order: the first calibrate, the next verify."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    ranked = rows.select(key, order.alias("_o")).orderBy("_o", key).limit(calibration + verification)
    place = F.row_number().over(Window.orderBy("_o", key))
    return ranked.withColumn("_p", place).select(key, F.when(F.col("_p") <= calibration, "calibration").otherwise("verification").alias("role"))
