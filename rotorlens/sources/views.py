"""Adapters: driver tables as recordings, channels, spectra, predictions and file names (long format)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Event types that stand for the channels of a recording.
CHANNELS = {"click": "I1", "view": "I2", "purchase": "I3", "error": "vib_x"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, grp, n, x, event_type: one recording per user, in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("rec"), (F.col("user_id") % 5).alias("grp"), (F.row_number().over(order) - 1).cast("long").alias("n"), F.col("value").alias("x"), "event_type")


def day_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, channel, n, x: one recording per day, with a planted loss of I1 and days without rotation."""
    day, channel = F.to_date("ts"), F.create_map(*[F.lit(v) for kv in CHANNELS.items() for v in kv])[F.col("event_type")]
    order = Window.partitionBy("rec", "channel").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").where(F.col("event_type").isin(list(CHANNELS))).select(day.alias("rec"), channel.alias("channel"), "ts", "event_id", "value")
    rows = rows.withColumn("n", (F.row_number().over(order) - 1).cast("long"))
    lost = (F.col("channel") == "I1") & (F.expr("n div 16") % 2 == 1)
    still = (F.col("channel") == "vib_x") & (F.dayofmonth("rec") % 2 == 0)
    return rows.select("rec", "channel", "n", (F.col("value") * F.when(lost, 0.002).when(still, 1e-6).otherwise(1.0)).alias("x"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, unit, label, bin, x: embedding components as samples."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), (F.col("vec_id") % 29).alias("unit"), "label", F.posexplode("embedding").alias("bin", "v")).select("rec", "unit", "label", F.col("bin").cast("long").alias("bin"), F.col("v").cast("double").alias("x"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, truth, pred, grp, rec."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("truth"), F.col("toxic").alias("pred"), F.col("source").alias("grp"), F.col("lang").alias("rec"))
