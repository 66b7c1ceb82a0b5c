"""Classification metrics, voting and pooling from rows (truth, pred)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def label_frame(spark: SparkSession, labels: list[int]) -> DataFrame:
    return spark.createDataFrame([(x,) for x in labels], "label int")


def confusion(rows: DataFrame, labels: list[int]) -> DataFrame:
    """truth, pred, n for every pair of declared labels; others are ignored."""
    spark = rows.sparkSession
    counts = rows.where(F.col("truth").isin(labels) & F.col("pred").isin(labels)).groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(a, b) for a in labels for b in labels], "truth int, pred int")
    return every.join(counts, ["truth", "pred"], "left").select("truth", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(rows: DataFrame, labels: list[int], by: list[str] | None = None) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1, support over the declared labels; undefined ratios are 0."""
    by = by or []
    sides = rows.select(*by, "truth", "pred", F.explode(F.array_distinct(F.array("truth", "pred"))).alias("label"))
    t, p = F.col("truth") == F.col("label"), F.col("pred") == F.col("label")
    counts = sides.groupBy(*by, "label").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    declared = label_frame(rows.sparkSession, labels)
    every = rows.select(*by).distinct().join(F.broadcast(declared)) if by else declared
    full = every.join(counts, [*by, "label"], "left").na.fill(0, ["tp", "fp", "fn"])
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return full.select(*by, "label", "tp", "fp", "fn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def macro_f1(rows: DataFrame, labels: list[int], by: list[str] | None = None) -> DataFrame:
    by = by or []
    return per_class(rows, labels, by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def accuracy() -> Column:
    return F.avg((F.col("truth") == F.col("pred")).cast("double"))


def scores(rows: DataFrame, labels: list[int], by: list[str] | None = None) -> DataFrame:
    """n, accuracy and macro-F1 (with the groups of `by`)."""
    by = by or []
    whole = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), accuracy().alias("accuracy"))
    m = macro_f1(rows, labels, by)
    return whole.join(m, by) if by else whole.join(F.broadcast(m))


def majority_baseline(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of the largest true class."""
    by = by or []
    counts = rows.groupBy(*by, "truth").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg((F.max("n") / F.sum("n")).alias("baseline"))


def balanced_accuracy(rows: DataFrame) -> DataFrame:
    """Mean recall over the classes that are present."""
    return rows.groupBy("truth").agg(accuracy().alias("recall")).agg(F.avg("recall").alias("balanced_accuracy"))


def soft_vote(probs: DataFrame, classes: int) -> DataFrame:
    """rec, truth, vote: class of the largest mean probability, the first on ties. probs: rec, truth, p (array)."""
    means = probs.groupBy("rec").agg(F.max("truth").alias("truth"), F.array(*[F.avg(F.get("p", F.lit(c))) for c in range(classes)]).alias("m"))
    return means.select("rec", "truth", (F.array_position("m", F.array_max("m")) - 1).cast("int").alias("vote"))


def hard_vote(rows: DataFrame) -> DataFrame:
    """rec, vote, votes: the most frequent prediction, the lowest class on ties."""
    counts = rows.groupBy("rec", "pred").agg(F.count(F.lit(1)).alias("votes"))
    return counts.groupBy("rec").agg(F.min_by(F.struct("pred", "votes"), F.struct(-F.col("votes"), "pred")).alias("v")).select("rec", F.col("v.pred").alias("vote"), F.col("v.votes").alias("votes"))


def aggregation_curve(probs: DataFrame, sizes: list[int], draws: int, classes: int, seed: int = 42) -> DataFrame:
    """pooled, accuracy: class of the mean over `pooled` observations of a unit, drawn `draws` times by hash order.

    probs: unit, rec, truth, p. Each draw ranks a unit's observations anew, so no sample is collected.
    """
    from pyspark.sql import Window

    drawn = probs.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    order = Window.partitionBy("unit", "draw").orderBy(F.xxhash64(F.lit(seed), "draw", "rec"), "rec")
    ranked = drawn.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(sizes))
    pooled = ranked.withColumn("pooled", F.explode(F.array(*[F.lit(s) for s in sizes]))).where("rank <= pooled")
    means = pooled.groupBy("pooled", "unit", "draw").agg(F.max("truth").alias("truth"), F.array(*[F.avg(F.get("p", F.lit(c))) for c in range(classes)]).alias("m"))
    right = ((F.array_position("m", F.array_max("m")) - 1) == F.col("truth")).cast("double")
    return means.groupBy("pooled").agg(F.avg(right).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def nearest_neighbour(rows: DataFrame, value: str = "v", label: str = "label", key: str = "rec") -> DataFrame:
    """key, label, pred: label of the nearest other row on a scalar, the smallest key on ties.

    Sorted by value, the nearest row is one of the two beside it, save for ties, which share their value
    or distance; so each distinct value carries its rows' least keys and looks one value to each side.
    """
    from pyspark.sql import Window

    ranked = rows.select(key, F.col(label).alias("label"), F.col(value).alias("v"))
    pair = F.struct(F.col(key).alias("k"), "label")
    # The least key of a value, then the least of the others: two aggregates that combine on the map side.
    least = ranked.groupBy("v").agg(F.min(pair).alias("a"))
    second = ranked.join(least, "v").where(F.col(key) != F.col("a.k")).groupBy("v").agg(F.min(pair).alias("b"))
    two = least.join(second, "v", "left").select("v", F.array_compact(F.array("a", "b")).alias("least"))
    # Distinct values are put in stretches of equal width; a stretch needs its neighbours' outermost values only.
    span = two.agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    dealt = two.join(F.broadcast(span)).withColumn("_s", F.floor((F.col("v") - F.col("_low")) / F.greatest(F.col("_high") - F.col("_low"), F.lit(1e-300)) * 4096)).drop("_low", "_high")
    ends = dealt.groupBy("_s").agg(F.min_by(F.struct("v", "least"), "v").alias("_first"), F.max_by(F.struct("v", "least"), "v").alias("_last"))
    across = Window.orderBy("_s")  # one row a stretch
    ends = ends.select("_s", F.lag("_last").over(across).alias("_before"), F.lead("_first").over(across).alias("_after"))
    w = Window.partitionBy("_s").orderBy("v")
    sided = dealt.join(F.broadcast(ends), "_s").select("v", "least", F.coalesce(F.lag("v").over(w), F.col("_before.v")).alias("lv"), F.coalesce(F.lag("least").over(w), F.col("_before.least")).alias("ll"), F.coalesce(F.lead("v").over(w), F.col("_after.v")).alias("rv"), F.coalesce(F.lead("least").over(w), F.col("_after.least")).alias("rl"))
    joined = ranked.join(sided, "v")
    own = F.filter("least", lambda s: s["k"] != F.col(key))
    options = F.array_compact(F.array(*[F.when(F.size(c) > 0, F.struct(F.abs(F.col("v") - at).alias("d"), F.get(c, F.lit(0))["k"].alias("k"), F.get(c, F.lit(0))["label"].alias("label"))) for c, at in ((own, F.col("v")), (F.col("ll"), F.col("lv")), (F.col("rl"), F.col("rv")))]))
    return joined.select(key, "label", F.array_min(options)["label"].alias("pred"))
