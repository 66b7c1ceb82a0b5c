"""Integer quantisation on long weight tables (o, i, v), integer linear layers, memory-file words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 127
#: Weights, some thirty bytes each, that are sent to every task.
BROADCAST_WEIGHTS = 1_000_000


def quantised(value: Column, scale: Column) -> Column:
    """Half to even, clipped to [-128, 127]."""
    return F.greatest(F.lit(-128.0), F.least(F.lit(127.0), F.rint(value / scale))).cast("int")


def _scale(largest: Column) -> Column:
    return F.when(largest > 0, largest / LIMIT).otherwise(1.0)


def per_channel(weights: DataFrame) -> DataFrame:
    """Adds scale (largest magnitude of the output channel / 127, or 1) and q."""
    w = weights.withColumn("scale", _scale(F.max(F.abs("v")).over(Window.partitionBy("o"))))
    return w.withColumn("q", quantised(F.col("v"), F.col("scale")))


def per_tensor(weights: DataFrame) -> DataFrame:
    """One scale for all; it comes from one aggregate that is sent to every task."""
    top = weights.agg(_scale(F.max(F.abs("v"))).alias("scale"))
    return weights.join(F.broadcast(top)).withColumn("q", quantised(F.col("v"), F.col("scale")))


def activation_scale(values: DataFrame, percentile: float = 0.999, by: list[str] | None = None, buckets: int = 4096) -> DataFrame:
    """Exact percentile (linear between ranks) of the magnitude / 127; 1 if it is 0.

    Counts of equal stretches between 0 and the largest magnitude tell where the two ranks lie; only the values of
    those stretches are put in order, so no buffer holds a group's distinct values.
    """
    by = by or []
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    rows = values.select(*by, key.alias("_k"), F.abs("v").cast("double").alias("_x"))
    top = rows.groupBy("_k").agg(F.max("_x").alias("_top"), F.count("_x").alias("_n"))
    dealt = rows.join(top, "_k").withColumn("_b", F.least(F.floor(F.col("_x") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0) * buckets), F.lit(buckets - 1)))
    sizes = dealt.groupBy(*by, "_k", "_b").agg(F.count("_x").alias("_size"), F.max("_n").alias("_n"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rank = (F.col("_n") - 1) * F.lit(percentile)
    begins = sizes.withColumn("_first", before).withColumns({"_low": F.floor(rank), "_high": F.ceil(rank), "_part": rank - F.floor(rank)})
    held = begins.where((F.col("_first") <= F.col("_high")) & (F.col("_first") + F.col("_size") > F.col("_low")))
    place = F.row_number().over(Window.partitionBy("_k", "_b").orderBy("_x")) - 1 + F.col("_first")
    near = dealt.select("_k", "_b", "_x").join(held, ["_k", "_b"]).withColumn("_i", place)
    pick = lambda c: F.max(F.when(F.col("_i") == F.col(c), F.col("_x")))
    two = near.groupBy(*by, "_k").agg(pick("_low").alias("a"), pick("_high").alias("b"), F.max("_part").alias("part"))
    p = F.col("a") + (F.col("b") - F.col("a")) * F.col("part")
    return two.select(*by, F.when(p > 0, p / LIMIT).otherwise(1.0).alias("scale"))


def headroom(layers: DataFrame, bits: int = 32) -> DataFrame:
    """layer, terms, bias_max -> peak accumulator, bits it needs, whether it fits."""
    peak = F.col("terms") * 128 * 127 + F.col("bias_max")
    need = (F.ceil(F.log2(peak + 1)) + 1).cast("int")
    return layers.select("layer", "terms", peak.cast("long").alias("peak"), need.alias("bits"), (need <= bits).alias("fits"))


def int8_linear(weights: DataFrame, inputs: DataFrame) -> DataFrame:
    """row, o, acc: integer products of quantised weights (o, i, q) and inputs (row, i, q).

    Weights up to BROADCAST_WEIGHTS go to every task; beyond it both sides shuffle. The sum over i is a map-side aggregate.
    """
    w = weights.select("o", "i", F.col("q").cast("long").alias("wq"))
    x = inputs.select("row", "i", F.col("q").cast("long").alias("xq"))
    few = w.count() <= BROADCAST_WEIGHTS
    return x.join(F.broadcast(w) if few else w, "i").groupBy("row", "o").agg(F.sum(F.col("wq") * F.col("xq")).alias("acc"))


def fold_batchnorm(w: Column, gamma: Column, beta: Column, mean: Column, var: Column, bias: Column, eps: float = 1e-5) -> tuple[Column, Column]:
    s = gamma / F.sqrt(var + eps)
    return w * s, (bias - mean) * s + beta


def hex_word(value: Column, bits: int) -> Column:
    """Two's complement, bits / 4 lower-case digits."""
    return F.lower(F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))), bits // 4, "0"))


def from_hex_word(word: Column, bits: int) -> Column:
    raw = F.conv(word, 16, 10).cast("long")
    return F.when(raw >= 1 << (bits - 1), raw - (1 << bits)).otherwise(raw)


def channel_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean and sample deviation, floored at 1e-6, of v."""
    return rows.groupBy(*by).agg(F.avg("v").alias("mean"), F.greatest(F.stddev_samp("v"), F.lit(1e-6)).alias("std"))


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """N / (C * n) per class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    return counts.select(label, "n", (F.sum("n").over(whole) / (F.count(F.lit(1)).over(whole) * F.col("n"))).alias("weight"))
