"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotorlens.llm import common, exact_dedup, quality_classifier, sentencepiece_codec, simhash, source_mix


def drop_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, common.table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one_of_each(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.repeated(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = sentencepiece_codec.encode(docs)
    return ids.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


def rested(stage):
    """The stage, begun by executors that hold no garbage of the one before."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.rested(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", rested(drop_bad)),
    ("exact dedup", rested(drop_copies)),
    ("simhash near-dedup", rested(drop_near_copies)),
    ("source mix", rested(mix_sources)),
    ("sentencepiece", rested(tokenise)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, kept = docs, []
        with common.tidied(spark, kept):  # what a stage sets aside for itself goes with it
            docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
            kept.append(docs)
        if name != STAGES[0][0]:
            common.drop(before)
    return docs


#: A fitted classifier, SimHash and byte-pair encoding have no SQL; tests compare with brute force.
ORACLE_SQL = None
