"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become integers, floor(scale * x), and are held sparsely: a block of candidates is one posting
list per component (places and weights of its non-zero entries). A block of queries walks the
components in turn; each query row's weight is scattered over the component's postings into a dense
array of scores. A partition selection keeps k per query and block, and a merge keeps the k best.

Queries and candidates meet in a grid: a cell holds a group of query blocks and a stripe of candidate blocks, so
that the stated set of queries is compared with all rows, tasks grow with both sides, a task holds a bounded
number of rows, and neither side is broadcast. A candidate is dealt once for every 8,192 queries, a query once
for every stripe.

Defined cases: vectors that are null or hold null or non-finite components take no part; an empty vector scores 0
with all others; vectors of different lengths score over their common components; scaled components and scores
are 64-bit integers, as the result has them; ties go to the smaller
vec_id; a query's own row is any row of its vec_id, so rows that repeat a vec_id are never its
candidates, and a repeated query vec_id asks once, with its least vector; null vec_ids take no part; an
empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows in a block of queries and of candidates: a score array has at most QUERIES * CANDIDATES entries.
QUERIES, CANDIDATES = 512, 4096
#: Query blocks in a group, candidate blocks in a stripe at most, and stripes at least, for each core, where there are so many blocks.
GROUP, STRIPE, STRIPES_A_CORE = 16, 16, 2


def integers(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    v = F.col(vector_col)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & good)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def _blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """block, ids, postings: n blocks by hash of vec_id, each sorted by vec_id; one row per block.

    A block is filled from a partition of its own rows; hashing spreads any run of ids evenly.
    """
    blocks = max(1, -(-n // size))

    def pack(key, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("vec_id", kind="stable")
        lengths = b["v"].map(len).to_numpy(np.int64)
        row = np.repeat(np.arange(len(b), dtype=np.int32), lengths)
        term = np.concatenate([np.arange(k, dtype=np.int32) for k in lengths])
        weight = np.concatenate([*b["v"].to_numpy(), np.zeros(0, np.int64)]).astype(np.int64)
        by_term = np.lexsort((row, term))
        by_term = by_term[weight[by_term] != 0]
        return pd.DataFrame({"block": [key[0]], "ids": [b["vec_id"].to_numpy(np.int64).tobytes()], "term": [term[by_term].tobytes()], "row": [row[by_term].tobytes()], "weight": [weight[by_term].tobytes()]})

    keyed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return keyed.groupBy("block").applyInPandas(pack, "block int, ids binary, term binary, row binary, weight binary")


def accumulate(query: tuple, candidate: tuple) -> np.ndarray:
    """Scores of all queries of a block against all candidates of a block, component by component."""
    (q_ids, q_term, q_row, q_weight), (c_ids, c_term, c_row, c_weight) = query, candidate
    scores = np.zeros((len(q_ids), len(c_ids)), np.int64)
    terms = np.intersect1d(q_term, c_term)  # posting lists are sorted by component
    for t, a, b, c, d in zip(terms, np.searchsorted(q_term, terms), np.searchsorted(q_term, terms, "right"), np.searchsorted(c_term, terms), np.searchsorted(c_term, terms, "right")):
        places, weights = c_row[c:d], c_weight[c:d]
        if len(places) == len(c_ids):  # a full list, in order
            scores[q_row[a:b]] += q_weight[a:b, None] * weights
        else:
            scores[np.ix_(q_row[a:b], places)] += q_weight[a:b, None] * weights
    return scores


def best_of(scores: np.ndarray, barred: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k largest scores that are not barred; of equal ones, those that stand first."""
    n = scores.shape[1]
    free = np.where(barred, np.iinfo(np.int64).min, scores)
    cut = np.partition(free, max(0, n - k), axis=1)[:, max(0, n - k)][:, None]
    above = (free > cut) & ~barred
    level = (free == cut) & ~barred
    room = k - above.sum(1)[:, None]
    return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))


def _unpacked(r) -> tuple:
    return tuple(np.frombuffer(r[name], kind) for name, kind in (("ids", np.int64), ("term", np.int32), ("row", np.int32), ("weight", np.int64)))


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERIES, candidate_block: int = CANDIDATES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query."""
    spark = vectors.sparkSession
    rows = common.stored(integers(vectors, scale, id_col, vector_col), "topk-rows")
    asked = common.stored(integers(queries, scale, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v")), "topk-queries")
    n, m = rows.count(), asked.count()
    c_blocks, groups = -(-max(1, n) // candidate_block), -(-max(1, m) // (query_block * GROUP))
    stripes = max(-(-c_blocks // STRIPE), min(c_blocks, STRIPES_A_CORE * spark.sparkContext.defaultParallelism))
    q, c = _blocks(asked, query_block, m), _blocks(rows, candidate_block, n)
    across = lambda name, size: F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias(name)
    q = q.select("*", F.pmod("block", F.lit(groups)).alias("group"), across("stripe", stripes))
    c = c.select("*", F.pmod("block", F.lit(stripes)).alias("stripe"), across("group", groups))

    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)]
        candidates = [_unpacked(r) for r in held.to_dict("records")]
        for query in map(_unpacked, asked.to_dict("records")):
            found = []
            for candidate in candidates:
                scores = accumulate(query, candidate)
                at, hit = best_of(scores, query[0][:, None] == candidate[0][None], k)
                found.append(np.stack([query[0][at], candidate[0][hit], scores[at, hit]]))
            ids, near, scores = np.concatenate(found, axis=1)
            order = np.lexsort((near, np.invert(scores), ids))  # the inverted score falls as the score rises
            ids, near, scores = ids[order], near[order], scores[order]
            starts = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))[: len(ids)]
            place = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids))))
            out.append(pd.DataFrame({"query_id": ids, "vec_id": near, "score": scores})[place < k])
        return pd.concat(out)

    found = q.groupBy("group", "stripe").cogroup(c.groupBy("group", "stripe")).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return topk(vectors, vectors.where("vec_id % 50 = 0"))


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_inner_product(q.v, c.v), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
