"""Files in and out: raw columns, telemetry text, memory words, feature caches under a contract, JSON results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import quant
from . import parsing

# Bytes before the first column of a raw start-up file, and its columns in order.
RAW_HEADER = 184
RAW_COLUMNS = ("vib_x", "vib_y", "vib_z", "I1", "I2", "I3", "V1", "V2", "V3")


def _name(path: str = "path"):
    return F.element_at(F.split(F.col(path), "/"), -1)


def raw_index(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """file, path, length of the raw files at path; a wrong length raises, since places of columns follow from it."""
    wanted = RAW_HEADER + 8 * rows * len(RAW_COLUMNS)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(path).select(_name().alias("file"), "path", "length")
    text = F.concat(F.col("file"), F.lit(f": {wanted} bytes expected, found "), F.col("length").cast("string"))
    return listed.withColumn("length", F.when(F.col("length") == wanted, F.col("length")).otherwise(F.raise_error(text).cast("long")))


def raw_columns(spark: SparkSession, path: str, columns: list[str], rows: int, stride: int = 1) -> DataFrame:
    """file, n, channel, x of some columns of the raw files; a column is one stretch of doubles, read without the others."""
    unknown = set(columns) - set(RAW_COLUMNS)
    if unknown:
        raise KeyError(f"no columns {sorted(unknown)}; there are {list(RAW_COLUMNS)}")
    raw_index(spark, path, rows).agg(F.sum("length")).collect()  # the contract, before any column is read

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, part, channel in zip(b["file"], b["part"], b["channel"]):
                x = np.frombuffer(part, "<f8")[::stride]
                yield pd.DataFrame({"file": file, "n": np.arange(len(x)), "channel": channel, "x": x})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(path)
    cut = F.array(*[F.struct(F.lit(c).alias("channel"), F.substring("content", RAW_HEADER + 8 * rows * RAW_COLUMNS.index(c) + 1, 8 * rows).alias("part")) for c in columns])
    return files.select(_name().alias("file"), F.explode(cut).alias("c")).select("file", "c.channel", "c.part").mapInPandas(run, "file string, n long, channel string, x double")


def telemetry(spark: SparkSession, path: str, expected: dict[str, int], values: int = 8) -> DataFrame:
    """file, n, t_s (from each file's first line), v of telemetry text files. Files, and lines in each, must be as expected."""
    lines = spark.read.text(path, wholetext=True).select(_name("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    parsed = parsing.clock_lines(lines, "line", values)
    by_file = Window.partitionBy("file")
    placed = parsed.withColumn("n", F.row_number().over(by_file.orderBy("at")) - 1).withColumn("t_s", F.col("t_s") - F.first("t_s").over(by_file.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    found = {r["file"]: r["n"] for r in placed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}  # one number a file
    if found != expected:
        raise ValueError(f"lines by file: expected {expected}, found {found}")
    return placed.select("file", F.col("n").cast("long").alias("n"), "t_s", "v")


def census(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """name, present: whether each expected file lies at path."""
    listed = spark.read.format("binaryFile").load(path).select(_name().alias("name")).distinct().withColumn("present", F.lit(True))
    wanted = spark.createDataFrame([(n,) for n in names], "name string")
    return wanted.join(listed, "name", "left").select("name", F.coalesce("present", F.lit(False)).alias("present"))


def same_recordings(samples: DataFrame, first: str, second: str) -> bool | None:
    """Whether two recordings of samples (rec, channel, n, x) agree in every channel and value; None if one is absent."""
    a, b = (samples.where(F.col("rec") == r).select("channel", "n", F.col("x").alias(f"x{k}")) for k, r in enumerate((first, second)))
    if a.isEmpty() or b.isEmpty():
        return None
    met = a.withColumn("in0", F.lit(True)).join(b.withColumn("in1", F.lit(True)), ["channel", "n"], "full_outer")
    return met.where(F.col("in0").isNull() | F.col("in1").isNull() | ~F.col("x0").eqNullSafe(F.col("x1"))).isEmpty()


# -- memory words ---------------------------------------------------------------------------------------------
def write_memory(values: DataFrame, path: str, bits: int) -> None:
    """The values (i, v) in order of i, one word of bits / 4 digits a line, in one file: a layer's weights, which are few."""
    words = values.orderBy("i").select(quant.hex_word(F.col("v"), bits).alias("value"))
    words.coalesce(1).write.mode("overwrite").text(path)


def read_memory(spark: SparkSession, path: str, bits: int) -> DataFrame:
    """i, v of the words at path."""
    words = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda w: F.trim(w) != "")).alias("i", "w"))
    return words.select(F.col("i").cast("long").alias("i"), quant.from_hex_word(F.trim("w"), bits).alias("v"))


def memory_layers(spark: SparkSession, path: str) -> dict[str, dict]:
    """Layers by name from scales.json beside the memory files: shape, scales and integer arrays."""
    specs = json.loads(spark.read.text(f"{path}/scales.json", wholetext=True).first()[0])
    out = {}
    for spec in specs["layers"]:
        read = lambda part, bits: np.array([r["v"] for r in read_memory(spark, f"{path}/{spec['name']}_{part}.mem", bits).orderBy("i").collect()])  # noqa: E731, B023
        out[spec["name"]] = spec | {"w": read("w", 8).reshape(spec["shape"]), "b": read("b", 32)}
    return out


# -- caches and results ---------------------------------------------------------------------------------------
def write_cache(features: DataFrame, path: str, settings: dict) -> dict:
    """Features (file, window, x, error) under the fingerprint of the settings; rows with an error are set apart.

    Returns the report: rows and files written, and failures with their files.
    """
    spark = features.sparkSession
    mark = spark.range(1).select(parsing.fingerprint(settings)).first()[0]
    features.write.mode("overwrite").parquet(f"{path}/all")
    kept = spark.read.parquet(f"{path}/all")
    report = kept.agg(F.count_if(F.col("error").isNull()).alias("rows"), F.count_distinct(F.when(F.col("error").isNull(), F.col("file"))).alias("files"), F.count_if(F.col("error").isNotNull()).alias("failures")).first().asDict()
    spark.createDataFrame([(mark, json.dumps(settings, sort_keys=True))], "fingerprint string, settings string").write.mode("overwrite").json(f"{path}/contract")
    return report | {"fingerprint": mark}


def load_cache(spark: SparkSession, path: str, settings: dict) -> DataFrame:
    """The features at path that have no error; raises if they are absent or were made under other settings."""
    try:
        mark = spark.read.json(f"{path}/contract").first()["fingerprint"]
    except AnalysisException as e:
        raise FileNotFoundError(f"no feature cache at {path}") from e
    wanted = spark.range(1).select(parsing.fingerprint(settings)).first()[0]
    if mark != wanted:
        raise ValueError(f"the cache at {path} has the fingerprint {mark}, the settings have {wanted}")
    return spark.read.parquet(f"{path}/all").where("error IS NULL").drop("error")


def failures(spark: SparkSession, path: str) -> DataFrame:
    """file, error of what could not be made."""
    return spark.read.parquet(f"{path}/all").where("error IS NOT NULL").select("file", "error")


def write_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """The results at path; None where there are none."""
    try:
        return spark.read.json(path)
    except AnalysisException:
        return None


def branch_metrics(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """branch, groups, f1, metric_name, protocol from each branch's results; nulls for a branch without any."""
    out = None
    for branch, path in paths.items():
        found = read_results(spark, path)
        if found is None:
            part = spark.createDataFrame([(branch, None, None, "macro_f1", None)], "branch string, groups long, f1 double, metric_name string, protocol string")
        else:
            part = found.limit(1).select(F.lit(branch).alias("branch"), F.col("groups").cast("long"), F.col("f1").cast("double"), F.coalesce(F.col("metric_name"), F.lit("macro_f1")).alias("metric_name"), F.col("protocol"))
        out = part if out is None else out.unionByName(part)
    return out
