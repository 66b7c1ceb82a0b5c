"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the total in proportion to its weight, but never more than max_epochs
times its own size; what a clamped source leaves over is dealt again by weight among the others until
nobody is above its cap. A target is met by whole repetitions of every document, one repetition more
for a seeded choice of documents, and a fractional repetition of the one document at the edge.

The choice orders a source's documents by a seeded hash of id and text and takes them until the rest is used
up. No source is ever sorted as one group: sizes are summed per hash bucket first, then per hash in the one
bucket that holds the edge, so all a source's documents need to know is one hash, its cut. Each document then
decides by itself; none is shuffled.

Rows of one id and text have one hash and one size. Where such a group lies on the edge, its rows are
numbered by file and stretch of rows, however large the group is; as they are the same, reruns agree.

Defined cases: a null or empty text has size 0 and takes 0 words; a null source is a source of its
own, last in order; a null doc_id is an id of its own; rows that repeat are rows of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, total_share: float = 1.0) -> DataFrame:
    """source, source_size, weight, target from rows (source, source_size); one row per source.

    The level L solves sum(min(cap, L * weight)) = total. Sources are walked in order of cap / weight:
    the clamped ones are a prefix of that order, so one running sum finds L. It works on the table of
    sources (one small row each), never on documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    named = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("long"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    walked = (
        named.withColumn("total", F.sum("source_size").over(everything) * F.lit(total_share))
        .withColumn("clamped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * max_epochs)
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("clamped")) / F.col("weight_left"))
        .withColumn("free", F.col("level") * F.col("weight") <= F.col("source_size") * max_epochs)
    )
    level = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(everything)["level"]
    cap = (F.col("source_size") * max_epochs).cast("double")
    return walked.withColumn("target", F.coalesce(F.least(cap, level * F.col("weight")), cap)).select("source", "source_size", "weight", "target")


def _key(seed: int, text_col: str) -> Column:
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-"))
    return F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def _bucket(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def figures(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """A row for each source of sized (source, size, key): of, source_size, target, whole, cut, same, left.

    Documents below the cut are taken once more, and `left` words of the `same` documents at the cut.
    """
    buckets = common.stored(sized.groupBy("source", _bucket(F.col("key")).alias("bucket")).agg(F.sum("size").alias("bucket_size")), "mix-buckets")
    goals = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    goal, whole = F.round("target").cast("long"), F.floor(F.round("target").cast("long") / F.col("source_size")).cast("long")
    some = F.col("source_size") > 0
    goals = goals.withColumn("whole", F.when(some, whole).otherwise(0)).withColumn("rest", F.when(some, goal - whole * F.col("source_size")).otherwise(0))
    goals = common.stored(goals, "mix-goals")
    # A bucket's place in its source: at most 4096 small rows a source.
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("below", F.coalesce(F.sum("bucket_size").over(running), F.lit(0)))
    rests = goals.select(F.col("source").alias("of"), "rest")
    crossed = (F.col("below") < F.col("rest")) & (F.col("rest") <= F.col("below") + F.col("bucket_size"))
    edges = placed.join(rests, F.col("source").eqNullSafe(F.col("of"))).where(crossed).select("of", F.col("bucket").alias("edge"), (F.col("rest") - F.col("below")).alias("rest"))
    edges = common.stored(edges, "mix-edges")  # one row a source at most
    inside = _met(sized, edges).where(_bucket(F.col("key")) == F.col("edge")).groupBy("source", "key").agg(F.count(F.lit(1)).alias("same"), F.sum("size").alias("key_size"), F.first("rest").alias("rest"))
    running = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("left", F.col("rest") - F.coalesce(F.sum("key_size").over(running), F.lit(0)))
    cuts = inside.where((F.col("left") > 0) & (F.col("left") <= F.col("key_size"))).select(F.col("source").alias("cut_of"), F.col("key").alias("cut"), "same", "left")
    whole = goals.select(F.col("source").alias("of"), "source_size", "target", "whole")
    return common.stored(whole.join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of"), "mix-figures")


#: Sources up to this many go to every executor, some hundred bytes each; beyond it the plan shuffles and salts.
BROADCAST_SOURCES = 100_000
SALTS = 32


def _met(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows (source, key, ...) with their source's row of by_source (of, ...)."""
    same = F.col("source").eqNullSafe(F.col("of"))
    if by_source.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(by_source), same).drop("of")
    salted = by_source.withColumn("salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("salt_of"))).drop("of", "salt", "salt_of")


def _decided(rows: DataFrame, by_source: DataFrame, whole_only: bool) -> DataFrame:
    """rows (source, size, key, file, row, ...) with their source's figures and extra, the words on top of whole repetitions."""
    met = _met(rows, by_source)
    share = lambda left, size: F.when(left * 2 >= size, size).otherwise(0) if whole_only else left
    at = F.coalesce(F.col("key") == F.col("cut"), F.lit(False))
    alone = F.when(at, share(F.col("left"), F.col("size"))).when(F.col("key") < F.col("cut"), F.col("size")).otherwise(0)
    if by_source.where("same > 1").isEmpty():
        return met.withColumn("extra", alone.cast("long"))
    tied = at & (F.col("same") > 1)
    stretch = ["source", "file", "stretch"]
    ties = met.where(tied).withColumn("stretch", F.bitmap_bucket_number("row"))
    before = Window.partitionBy("source").orderBy("file", "stretch").rowsBetween(Window.unboundedPreceding, -1)
    counted = ties.groupBy(*stretch).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counted = common.stored(counted.select(F.struct(*stretch).alias("of_stretch"), "before"), "mix-ties")
    place = F.row_number().over(Window.partitionBy(*stretch).orderBy("row"))
    met_ties = ties.withColumn("place", place).join(counted, F.struct(*stretch).eqNullSafe(F.col("of_stretch")))
    room = F.col("left") - (F.col("before") + F.col("place") - 1) * F.col("size")
    some = F.when(room <= 0, 0).when(room >= F.col("size"), F.col("size")).otherwise(share(room, F.col("size")))
    return met.where(~tied).withColumn("extra", alone.cast("long")).unionByName(met_ties.withColumn("extra", some.cast("long")).drop("stretch", "place", "before", "of_stretch"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 42, whole_only: bool = False, text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, whole (repetitions), extra (words on top), taken.

    whole_only rounds the fractional repetition at the edge to none or all of that document.
    """
    # Columns are picked by name first, so that others can't clash with those made here.
    sized = common.stored(docs.select("doc_id", "source", common.word_count(F.col(text_col)).alias("size"), _key(seed, text_col).alias("key")), "mix-sizes")
    located = sized.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    mixed = _decided(located, figures(sized, weights, max_epochs), whole_only)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 42) -> DataFrame:
    """The mix as rows of docs: each document as often as its source's target says, whole documents only."""
    scan, _ = common.on_file(docs, "mix-docs")
    sized = scan.select("source", common.word_count(F.col("text")).alias("size"), _key(seed, "text").alias("key"))
    by_source = figures(common.stored(sized, "mix-sizes"), weights, max_epochs)
    rows = scan.select("source", common.word_count(F.col("text")).alias("size"), _key(seed, "text").alias("key"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.struct(*scan.columns).alias("own"))
    times = (F.col("whole") + F.when(F.col("extra") > 0, 1).otherwise(0)).cast("int")
    mixed = _decided(rows, by_source, whole_only=True).withColumn("times", times).where("times > 0")
    return mixed.select("own", F.explode(F.sequence(F.lit(1), F.col("times")))).select("own.*")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "whole", "extra")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('42:' || coalesce('=' || CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS weight FROM s),
w AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER f, 0) * 3 AS clamped,
    sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS weight_left
  FROM n WINDOW f AS (ORDER BY source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, CAST(total - clamped AS DOUBLE) / CAST(weight_left AS DOUBLE) AS level FROM w),
l AS (SELECT level FROM v WHERE level * weight <= source_size * 3 ORDER BY source_size / weight, level LIMIT 1),
t AS (SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), coalesce((SELECT level FROM l), 1e300) * weight) AS target FROM v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) - whole * source_size ELSE 0 END AS rest FROM g),
p AS (
  SELECT d.doc_id, d.source, d.size, r.source_size, r.target, r.whole,
    r.rest - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, room)) AS BIGINT) AS taken, source,
  CAST(whole AS BIGINT) AS whole, CAST(greatest(0, least(size, room)) AS BIGINT) AS extra
FROM p
"""
