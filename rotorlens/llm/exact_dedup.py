"""Exact deduplication by a stateful stream [native].

Rows flow once through Structured Streaming into keyed RocksDB state, which lives on disk, is
checkpointed to the shared folder and never expires. Per digest of the normalised text it holds the
group's size, the identifier of the row that stays and a content locator (file and row index). Each
digest that was hit more than once is then verified on the full bytes. Everything is DataFrame code.

With a state_dir the state is retained there: a later call over the same folder streams the files that
have come since and no others, and they meet the digests of all files before.

Defined cases: a null text counts as empty; empty texts are one group; doc_ids may be of any type that can be
ordered, and a null one sorts after all others; of rows that tie on length and doc_id the one with the least
locator stays, so repeated rows lose all but one; an empty table gives an empty result; other columns are
never read; a folder's path may end in a slash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Many small stores: no space set aside for logs that stay short.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Most digests that the verification sends to every executor (32 bytes each); beyond it, it shuffles.
BROADCAST_DIGESTS = 200_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(frame: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Digest, order key (greatest stays) and normalised text of each row; locators come from the scan."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return frame.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).cast("long").alias("n"),
        F.regexp_replace(text, common.SPACE + "+", "").alias("norm"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    ).withColumn("digest", digest(F.col("norm")))


def _rank() -> Column:
    """Least first: most code points, then smallest doc_id (null last), then locator."""
    return F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "file", "row")


def _streamed_state(spark: SparkSession, path: str, schema, id_col, text_col, digest, state_dir: str | None) -> DataFrame:
    """digest, best (rank of the row that stays), group_size after all rows have passed the state."""
    if state_dir:
        out, checkpoint = f"{state_dir}/updates", f"{state_dir}/state"
    else:
        out, checkpoint = common.fresh_path(spark, "dedup-updates"), common.fresh_path(spark, "dedup-state")
    # A stream's path must be a folder or a pattern; as a pattern it may also name a single file.
    source = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
    rows = _rows(source, id_col, text_col, digest)
    state = rows.groupBy("digest").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("seen"))
    spark.createDataFrame([], state.schema).write.mode("overwrite").parquet(f"{out}/batch=none")

    def upsert(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")  # a repeated batch replaces itself

    with common.conf(spark, STATE_CONF):
        query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(upsert).start()
        query.awaitTermination()
    if not state_dir:
        common.drop_path(spark, checkpoint)
    # A later batch only betters a group's best row and raises its size.
    updates = spark.read.schema(state.schema).parquet(f"{out}/batch=*")
    groups = common.stored(updates.groupBy("digest").agg(F.min("best").alias("best"), F.max("seen").alias("group_size")), "dedup-groups")
    if not state_dir:
        common.drop_path(spark, out)
    return groups


def exact_dedup(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state_dir: str | None = None) -> DataFrame:
    """One row per stored row: doc_id, keep_id, group_size, kept, text_sha256 and its locator (file, row).

    digest may be any function of the normalised text; a weak one costs time and no correctness, since
    texts that share a digest but differ in bytes are told apart by a full comparison. state_dir, a shared
    folder, retains the state between calls.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).select(id_col, text_col).schema
    state = _streamed_state(spark, path, schema, id_col, text_col, digest, state_dir)
    rows = _rows(spark.read.schema(schema).parquet(path), id_col, text_col, digest)

    # Hits: compare full bytes. Minimum and maximum of a digest's texts are equal if all are.
    hits = state.where("group_size > 1").select("digest")
    few = hits.count() <= BROADCAST_DIGESTS
    suspects = rows.join(F.broadcast(hits) if few else hits, "digest", "left_semi").select("digest", "norm")
    spread = suspects.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    collided = common.stored(spread.where("low <> high").select("digest"), "dedup-collisions")

    narrow = rows.select("doc_id", "n", "file", "row", "digest", F.sha2("norm", 256).alias("text_sha256"))
    if collided.isEmpty():
        decided = narrow.join(state, "digest", "left")
    else:
        exact = rows.join(collided, "digest", "left_semi").withColumn("own", F.sha2("norm", 512))
        groups = exact.groupBy("norm").agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        told = exact.join(groups, "norm").select("doc_id", "n", "file", "row", "digest", F.sha2("norm", 256).alias("text_sha256"), "best", "group_size")
        decided = narrow.join(collided, "digest", "left_anti").join(state, "digest", "left").unionByName(told)
    return decided.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.struct("best.file", "best.row") == F.struct("file", "row")).alias("kept"),
        "text_sha256",
        "file",
        "row",
    )


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with the columns of docs, whatever other columns it has."""
    scan, path = common.on_file(docs, "dedup-docs")
    return common.without_rows(scan, exact_dedup(spark, path).where("NOT kept").select("file", "row"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
k AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM k
"""
