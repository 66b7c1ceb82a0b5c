"""Near copies by SimHash and vantage-point trees, checked by exact Jaccard similarity of shingle sets; prefix filtering
finds the rest.

Sets: the distinct XXH64 hashes (seed 42) of the text's five-word shingles, words as in simhash; fewer words: the
whole sequence; no words: the empty set. Two texts link if |A & B| / |A | B| >= 4/5, in whole numbers and on the
whole sets (of hashes; two shingles of one hash count as one). Equal sets are one node.

SimHash: a set's fingerprint has the bits that over half of its hashes have. Fingerprints within RADIUS bits link by
simhash's trees, equal ones too, and a link holds if the whole sets are near. At a similarity of 0.8 about ten of 64
bits differ, where such trees prune nothing, so pairs beyond the radius that the contract links are left to the join:

Candidates: all sets are ordered alike, rare shingles first. Sets that link share one of their first
n - ceil(4n/5) + 1 shingles, so nothing is missed, whatever the order. A bounded sample of texts tells which
shingles are common; it sets the order, and so the work, and never the result.

A large group of near copies would have a square of pairs, and only components are asked for. So what
SimHash has linked is one component already, and the join's first rounds compare neighbours alone (by size, then by a hash), at most one pair a row. The last round takes every pair that shares a
prefix shingle, lies in two components so far and passes bounds that no linked pair can fail (sizes, places of the
shingle, and differing bits of 1,024 parities). Before whole sets meet, parities of a bit a shingle do. Groups above HOT rows are split into pieces that meet in pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from . import common, simhash

WIDTH = 5
#: Texts that tell which shingles are common, in how many of them one is, and most that are broadcast.
SAMPLE, COMMON, RANKED = 4000, 3, 100_000
#: Rows of a piece of a group, and rows of a group that is compared without parities at first.
HOT = 4000
FEW = 16
PARITIES = 1024
#: Differing bits within which fingerprints link.
RADIUS = 2
#: Least blocks of nodes that pairs are checked in, bytes of rows in a block, and pairs of two blocks.
BLOCKS, BLOCK_BYTES, BLOCK_PAIRS = 16, 16_000_000, 200_000


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    span = min(width, len(words)) - 1
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], simhash.SEED) for a, b in zip(starts[:n].tolist(), ends[span : span + n].tolist())), np.uint64, n))


def near(a: int, b: int, both: int) -> bool:
    return 5 * both >= 4 * (a + b - both)


def fingerprint(found: np.ndarray) -> bytes:
    """SimHash of a set of hashes."""
    return simhash.majority(sum((simhash.votes(found[at : at + simhash.SLICE]) for at in range(0, len(found), simhash.SLICE)), np.zeros(64, np.int64)), len(found))


def alike(prints: DataFrame) -> DataFrame:
    """a, b: pairs of nodes (rows node, fp) that connect all whose fingerprints link, by simhash's vantage-point trees."""
    classes = common.stored(prints.groupBy("fp").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "near-classes")
    again = classes.where("n > 1").select("fp", "least")
    equal = prints.join(again, "fp").where("node > least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    name = lambda c: classes.select(F.col("fp").alias(f"fp_{c}"), F.col("least").alias(c))
    links = common.stored(simhash.links(classes.select("fp"), RADIUS).toDF("fp_a", "fp_b"), "near-fp-links")
    close = links.join(name("a"), "fp_a").join(name("b"), "fp_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.unionByName(close).distinct()


def prefix(found: np.ndarray, ranked: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles in the order of all texts; ranked is ascending, and rank grows with how common each is."""
    n = len(found)
    if not n:
        return found
    level = np.zeros(n, np.int64)
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, found), len(ranked) - 1)
        level = np.where(ranked[at] == found, rank[at], 0)
    return found[np.lexsort((found, level))[: n - (-(-4 * n // 5)) + 1]]


def parities(found: np.ndarray) -> list[int]:
    """Bit k: whether an odd number of hashes are k modulo PARITIES. Sets differ in at least as many shingles as bits."""
    counts = np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64).tolist()


def wide_parities(found: np.ndarray) -> bytes:
    """As parities(), over a bit or more for each shingle, a power of two of them. Of sets that share little, about
    half a bit a shingle differs; of near ones, less than a quarter."""
    bits = 1 << max(PARITIES.bit_length() - 1, len(found).bit_length())
    counts = np.bincount((found % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits that differ between two wide parities, both folded to the shorter one."""
    a, b = (np.frombuffer(x, np.uint8) for x in (a, b))
    width = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(x.reshape(-1, width), axis=0) for x in (a, b))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several sampled texts hold, ascending, and their ranks from 1, the most common last."""
    every = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["text"]:
                yield pd.DataFrame({"shingle": shingles(t).view(np.int64)})

    held = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInPandas(common.lean(run), "shingle long")
    counted = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    rows = counted.orderBy(F.desc("n"), "shingle").limit(RANKED).collect()
    ranked = np.array([r["shingle"] for r in reversed(rows)], np.int64).view(np.uint64)
    order = np.argsort(ranked)
    return ranked[order], order + 1


def _parted(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows, which come sorted by keys, in frames of whole groups, and the end of each row's group."""
    rest = None
    for batch in batches:
        frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        k = frame[keys].to_numpy()
        starts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        rest = frame
        if len(starts):
            rest = frame.iloc[starts[-1] :].reset_index(drop=True)
            bounds = np.concatenate(([0], starts))
            yield frame.iloc[: starts[-1]], np.repeat(bounds[1:], np.diff(bounds))
    if rest is not None:
        yield rest, np.full(len(rest), len(rest))


def candidates(rows: DataFrame, parity: DataFrame) -> DataFrame:
    """a, b: pairs of rows (shingle, node, n, pos, root, held) of one shingle and two roots that may be near.

    pos is the shingle's place in the node's order: what two sets share lies before or behind it in both. held: the
    shingle's rows. parity: node, parity.
    """
    sized = rows.withColumn("pieces", F.ceil(F.col("held") / HOT).cast("int"))
    few = sized.where(F.col("held") <= FEW).withColumn("parity", F.lit(None).cast("array<long>"))
    sized = few.unionByName(sized.where(F.col("held") > FEW).join(parity, "node"))
    keys = ["shingle", "first", "second"]
    paired = simhash.pieced(sized, F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")).select(*keys, "own", "node", "n", "pos", "root", "parity")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, end in _parted(batches, keys):
            node, n, pos, root, own, one, two = (frame[c].to_numpy(np.int64) for c in ("node", "n", "pos", "root", "own", "first", "second"))
            none = np.zeros(PARITIES // 64, np.int64)
            # Unsigned: of a negative number, NumPy counts the bits of the absolute value.
            bits = np.array([none if p is None else p for p in frame["parity"]], np.int64).view(np.uint64)
            i, step = np.arange(len(frame)), 1
            while len(i := i[i + step < end[i]]):
                j = i + step
                low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
                ok = (root[i] != root[j]) & ((own[i] != own[j]) | (one[i] == two[i])) & (5 * low >= 4 * high) & (9 * most >= 4 * (low + high))
                a, b = i[ok], j[ok]
                ok = 9 * np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= n[a] + n[b]
                a, b = node[a[ok]], node[b[ok]]
                if len(a):
                    yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
                step += 1

    return paired.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(common.lean(search), "a long, b long").distinct()


def _met(pairs: DataFrame, rows: DataFrame, held, keep) -> DataFrame:
    """The stored pairs of a, b that keep(row of a, row of b) is true of; rows: node and what keep reads, stored.

    Nodes are dealt into blocks, and a task meets the pairs of two blocks with the rows of both. So a row moves at most
    twice for each block, however many pairs it stands in. held: a row's bytes, which tell how many blocks there are.
    """
    blocks = max(BLOCKS, -(-int(rows.agg(F.sum(held)).first()[0] or 0) // BLOCK_BYTES), math.isqrt(pairs.count() // BLOCK_PAIRS))
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    dealt = pairs.select("a", "b", of("a").alias("x"), of("b").alias("y"))
    wanted = common.stored(dealt.select("x", "y", F.explode(F.array("a", "b")).alias("node")).distinct(), "near-wanted")

    def meet(some: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        read = dict(zip(own["node"], own.drop(columns=["node", "x", "y"]).itertuples(index=False, name=None)))
        return some.loc[np.array([keep(read[a], read[b]) for a, b in zip(some["a"], some["b"])], bool), ["a", "b"]]

    sent = rows.join(common.small(wanted), "node")
    return dealt.groupBy("x", "y").cogroup(sent.groupBy("x", "y")).applyInPandas(meet, "a long, b long")


def bounded(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The pairs of a, b whose wide parities differ in no more bits than near sets of their sizes can; marks: node, n, wide."""
    pairs = common.stored(pairs, "near-candidates")
    ends = common.stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-ends")
    rows = common.stored(marks.select("node", "n", "wide").join(common.small(ends), "node", "left_semi"), "near-wide", [ends])
    found = _met(pairs, rows, F.length("wide"), lambda x, y: 9 * differing(x[1], y[1]) <= x[0] + y[0])
    return common.stored(found, "near-pairs", [pairs, rows])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The stored pairs whose whole sets (stored rows node, found) are near."""

    def keep(x: tuple, y: tuple) -> bool:
        x, y = np.frombuffer(x[0], np.uint64), np.frombuffer(y[0], np.uint64)
        return near(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))

    return _met(pairs, sets, F.length("found"), keep)


def _marked(texts: DataFrame, carried: list[str], order) -> DataFrame:
    """carried columns of texts, whatever their types, with digest, n, fingerprint, parity, wide parity and prefix of each text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingles(t.as_py()) for t in b.column("__rl_text")]  # one text is a Python object at a time
            new = [
                pa.array([hashlib.blake2b(f.tobytes(), digest_size=16).digest() for f in made], pa.binary()),
                pa.array([len(f) for f in made], pa.int64()),
                pa.array([fingerprint(f) for f in made], pa.binary()),
                pa.array([parities(f) for f in made], pa.list_(pa.int64())),
                pa.array([wide_parities(f) for f in made], pa.binary()),
                pa.array([prefix(f, *order.value).view(np.int64) for f in made], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in carried], *new], [*carried, "digest", "n", "fp", "parity", "wide", "prefix"])

    schema = texts.select(*carried).schema.add("digest", "binary").add("n", "long").add("fp", "binary").add("parity", ArrayType(LongType())).add("wide", "binary").add("prefix", ArrayType(LongType()))
    return texts.select(*carried, F.col("text").alias("__rl_text")).mapInArrow(common.lean(run), schema)


def near_rows(docs: DataFrame) -> DataFrame:
    """doc_id, file, row and `root`, the same for rows of one component; one row per row of docs, a plain scan."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(common_shingles(docs.select("doc_id", "text")))
    carried = ["doc_id", "file", "at"]
    placed = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    marked = common.stored(_marked(placed, carried, order).withColumn("node", F.monotonically_increasing_id()), "near-marked")
    # Of the rows of one set, the first is the node; the others are listed with it.
    nodes = common.stored(marked.groupBy("digest").agg(F.min("node").alias("of"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows"), "near-nodes")
    again = marked.select("node", "digest").join(common.small(nodes), "digest").where("node <> of").select(F.col("node").alias("again"), "of")
    again = common.small(common.stored(again, "near-again", [nodes]))
    first = marked.join(again, F.col("node") == F.col("again"), "left_anti")

    def rooted(rows: DataFrame, roots: DataFrame, *by) -> DataFrame:
        """Rows of shingles that still lie in two components, with root, held (the shingle's rows) and the row before."""
        named = rows.join(roots, "node", "left").select("shingle", "node", "n", "pos", F.coalesce("__root", "node").alias("root"))
        w = Window.partitionBy("shingle")
        before = F.lag(F.struct("node", "n", "root")).over(w.orderBy(*by, "node"))
        seen = named.withColumns({"low": F.min("root").over(w), "high": F.max("root").over(w), "held": F.count(F.lit(1)).over(w), "before": before})
        return seen.where("low < high").drop("low", "high")

    def pairs(rows: DataFrame) -> DataFrame:
        fit = rows.where("before IS NOT NULL AND before.root <> root AND 5 * least(before.n, n) >= 4 * greatest(before.n, n)")
        return fit.select(F.least("node", "before.node").alias("a"), F.greatest("node", "before.node").alias("b")).distinct()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [shingles(t).tobytes() for t in b["text"]]
            yield pd.DataFrame({"digest": [hashlib.blake2b(f, digest_size=16).digest() for f in made], "found": made})

    def linked(found: DataFrame) -> DataFrame:
        """The near ones of the pairs; their sets are made anew from the texts of their nodes."""
        found = bounded(found, first)
        ends = common.stored(found.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-ends")
        wanted = common.stored(marked.select("node", "digest", "file", F.col("at").alias("row")).join(common.small(ends), "node", "left_semi"), "near-wanted", [ends])
        texts = common.only_rows(docs.select("text"), wanted.select("file", "row"))
        made = texts.mapInPandas(common.lean(whole), "digest binary, found binary").join(common.small(wanted.select("digest", "node")), "digest")
        sets = common.stored(made.select("node", "found"), "near-sets", [wanted])
        return common.stored(verified(found, sets), "near-links", [found, sets])

    edges = linked(alike(first.select("node", "fp")))
    rows = first.select("node", "n", F.posexplode("prefix").alias("pos", "shingle"))
    by_hash = F.xxhash64("node")
    for k, order in enumerate(("n", by_hash, by_hash)):
        roots = common.small(common.stored(simhash.components(edges).withColumnRenamed("root", "__root"), "near-roots"))
        rows = common.stored(rooted(rows, roots, order), "near-rooted", [rows] if k else [])
        if rows.isEmpty():
            break
        more = linked(candidates(rows, first.select("node", "parity")) if k == 2 else pairs(rows))
        edges = common.stored(edges.unionByName(more), "near-edges", [edges, more])
    roots = common.small(common.stored(simhash.components(edges).withColumnRenamed("root", "__root"), "near-roots"))
    named = marked.select("doc_id", "file", F.col("at").alias("row"), "node").join(again, F.col("node") == F.col("again"), "left").withColumn("node", F.coalesce("of", "node"))
    return named.join(roots, "node", "left").select("doc_id", "file", "row", F.coalesce("__root", "node").alias("root"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id of the component), one row per row of docs."""
    rows = common.stored(near_rows(common.on_file(docs, "near-docs")[0]), "near-rows")
    least = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "root").select("doc_id", "component_id")
