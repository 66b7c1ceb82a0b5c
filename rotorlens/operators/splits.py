"""Fold tables and leak checks. A fold assignment is (row key, fold, role); data are joined back by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leave_one_group_out(rows: DataFrame, group: str = "grp") -> DataFrame:
    """fold, held: one fold per group in sorted order. Rows need no copies: role_in_fold() derives roles."""
    groups = rows.select(F.col(group).alias("held")).distinct()
    return groups.select((F.row_number().over(Window.orderBy("held")) - 1).cast("long").alias("fold"), "held")


def roles(rows: DataFrame, folds: DataFrame, group: str = "grp") -> DataFrame:
    """Counts of rows by fold, group and role, from one count per group."""
    sizes = rows.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    # Both sides are one row a group; a fold meets every group by definition.
    every = folds.agg(F.collect_list(F.struct("fold", "held")).alias("f"))
    return sizes.join(F.broadcast(every)).select("grp", "n", F.explode("f").alias("f")).select("f.fold", "grp", F.when(F.col("grp") == F.col("f.held"), "test").otherwise("train").alias("role"), "n")


def verify_folds(folds: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups that are not tested exactly once, and tested ones that are no groups; empty if the folds are sound."""
    tested = folds.groupBy("held").agg(F.count(F.lit(1)).alias("times"))
    met = groups.join(tested, groups["grp"] == tested["held"], "full_outer")
    return met.where(F.col("grp").isNull() | F.col("held").isNull() | (F.col("times") != 1)).select(F.coalesce("grp", "held").alias("grp"), F.coalesce("times", F.lit(0)).cast("long").alias("times"))


def leaks(assigned: DataFrame, group: str = "grp", declared: Column | None = None) -> DataFrame:
    """fold and group of every group that is in training and test of one fold, unless `declared` says the fold is leaky."""
    checked = assigned if declared is None else assigned.where(~declared)
    both = checked.groupBy("fold", group).agg(F.count_distinct("role").alias("roles"))
    return both.where("roles > 1").select("fold", F.col(group).alias("grp"))


def shared_rows(assigned: DataFrame, key: str = "row", declared: Column | None = None) -> DataFrame:
    """fold and key of every row that trains and tests in one fold."""
    return leaks(assigned, key, declared).withColumnRenamed("grp", key)


def refused(folds: DataFrame, least: int) -> DataFrame:
    """folds, or an error if they are fewer than `least`."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    text = F.concat(F.lit(f"{least} groups are needed, there are "), n.cast("string"))
    return folds.withColumn("fold", F.when(n >= least, F.col("fold")).otherwise(F.raise_error(text).cast("long")))


def described(rows: DataFrame, group: str = "grp", label: str = "label") -> DataFrame:
    """One line a label with its groups and rows, and one for all."""
    counts = rows.rollup(label).agg(F.count_distinct(group).alias("groups"), F.count(F.lit(1)).alias("n"))
    return counts.select(F.format_string("%-12s %4d groups %7d rows", F.coalesce(F.col(label).cast("string"), F.lit("all")), "groups", "n").alias("line"))


def saved_folds(folds: DataFrame, path: str) -> DataFrame:
    folds.write.mode("overwrite").json(path)
    return folds.sparkSession.read.schema(folds.schema).json(path)


def reloaded_folds(spark, path: str, groups: DataFrame) -> DataFrame:
    """The folds at path; raises unless they hold out exactly these groups (grp), each once."""
    folds = spark.read.schema("fold long, held long").json(path)
    wrong = verify_folds(folds, groups)
    if not wrong.isEmpty():
        raise ValueError(f"the stored folds do not cover the groups: {[tuple(r) for r in wrong.limit(5).collect()]}")
    return folds


def holdout(rows: DataFrame, condition: Column, key: str) -> DataFrame:
    """Rows with role test where the condition holds."""
    return rows.select(key, F.when(condition, "test").otherwise("train").alias("role"))


def contiguous_block(rows: DataFrame, share: float, purge: int, key: str, order: list[str], group: list[str] | None = None) -> DataFrame:
    """key, role: the first part of each group trains, the last part tests, `purge` rows before the cut are neither."""
    purge = max(1, purge)
    by = Window.partitionBy(*(group or []))
    place = F.row_number().over(by.orderBy(*order)) - 1
    placed = rows.withColumn("_i", place).withColumn("_cut", F.rint(F.count(F.lit(1)).over(by) * share))
    role = F.when(F.col("_i") >= F.col("_cut"), "test").when(F.col("_i") < F.col("_cut") - purge, "train").otherwise("purged")
    return placed.select(key, *(group or []), role.alias("role"))


def _ranked(rows: DataFrame, order: Column, key: str, by: list[str], buckets: int = 1024) -> DataFrame:
    """rows with _i, the place from 0 in (order, key) of each group of `by`, and _n, its size.

    order is a column of hexadecimal hashes: its first digits deal rows to buckets, whose sizes (at most
    `buckets` rows a group) give where each bucket begins, so no task sorts a whole group.
    """
    dealt = rows.withColumn("_o", order).withColumn("_b", F.floor(F.conv(F.substring("_o", 1, 5), 16, 10).cast("long") * buckets / 2**20).cast("int"))
    sizes = dealt.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_size"))
    w = Window.partitionBy(*by)
    begins = sizes.withColumn("_first", F.coalesce(F.sum("_size").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_size").over(w)).drop("_size")
    placed = dealt.join(begins, [*by, "_b"])
    return placed.withColumn("_i", F.col("_first") + F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_o", key)) - 1).drop("_o", "_b", "_first")


def shuffled(rows: DataFrame, n_folds: int, seed: int, key: str, strata: list[str] | None = None) -> DataFrame:
    """key, fold: leaky folds by order of a hash; the first n % k folds hold one more."""
    placed = _ranked(rows.select(key, *(strata or [])), F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key, strata or [])
    small, extra = F.expr(f"_n div {n_folds}"), F.col("_n") % n_folds
    edge = extra * (small + 1)
    fold = F.when(F.col("_i") < edge, F.floor(F.col("_i") / (small + 1))).otherwise(extra + F.floor((F.col("_i") - edge) / F.greatest(small, F.lit(1))))
    return placed.select(key, *(strata or []), fold.cast("long").alias("fold"))


def inner_split(groups: DataFrame, per_class: int, seed: int) -> DataFrame:
    """grp, label, role: per class, `per_class` whole groups validate, by hash, and never all of a class."""
    by = Window.partitionBy("label")
    rank = F.row_number().over(by.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("grp").cast("string"))), "grp"))
    return groups.withColumn("_r", rank).withColumn("_n", F.count(F.lit(1)).over(by)).select("grp", "label", F.when((F.col("_r") <= per_class) & (F.col("_n") > per_class), "validation").otherwise("fit").alias("role"))


def evenly_spaced(rows: DataFrame, most: int, order: str) -> DataFrame:
    """At most `most` rows at rounded even spacing over a numeric order, first and last included.

    Counts of `order` in equal stretches say in which stretch each wanted place lies; only those stretches' rows
    are put in order, each on its own.
    """
    stretches = 4096
    span = rows.agg(F.min(order).alias("_low"), F.max(order).alias("_high"), F.count(F.lit(1)).alias("_n"))
    share = (F.col(order) - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1))
    dealt = rows.join(F.broadcast(span)).withColumn("_b", F.least(F.floor(share * stretches), F.lit(stretches - 1)))
    sizes = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_size"), F.max("_n").alias("_n"))
    first = F.coalesce(F.sum("_size").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.withColumn("_first", first)  # one row a stretch
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.rint(k * (F.col("_n") - 1) / max(most - 1, 1)).cast("long")))
    inside = F.filter(wanted, lambda i: (i >= F.col("_first")) & (i < F.col("_first") + F.col("_size")))
    held = begins.withColumn("_want", inside).where(F.size("_want") > 0).select("_b", "_first", "_want")
    placed = dealt.drop("_low", "_high", "_n").join(F.broadcast(held), "_b").withColumn("_i", F.col("_first") + F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1)
    return placed.where(F.array_contains("_want", F.col("_i"))).select(*rows.columns)
