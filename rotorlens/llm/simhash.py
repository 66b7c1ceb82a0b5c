"""SimHash near-duplicate detection with vantage-point trees.

Fingerprints: words `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, shingles of `width` words
joined by one space (fewer words: the whole sequence), XXH64 with seed 42; a bit is set if it is set in
over half of the hashes. Longer fingerprints mix each hash further. No words: fingerprint zero.

Links: two fingerprints link at `radius` or fewer differing bits. Only distinct fingerprints are
searched, in shards. A top vantage-point tree over a bounded sample splits the space; a fingerprint goes to
its home shard and, wherever |d(x, vantage) - cut| <= radius, to the other side too, so that every
pair within the radius meets in the home shard of one of the two. This finds all pairs.
Each shard builds its own tree and searches it with the same triangle bounds. A shard above HOT rows is
split into pieces of about HOT rows; a task compares two of them, so none holds a whole hot group. What leaves a shard is a
spanning forest of its links, so a dense ball of n fingerprints yields fewer than n rows.

Components: every node follows its least neighbour, with pointer jumping, in rounds that are written to
the shared folder.

Defined cases: a null text counts as empty; empty texts share the fingerprint zero and link like any
others; component_id is the smallest doc_id of the component and null only if all of them are; rows
that repeat are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEED = 42
#: Shingles hashed at a time, so that a text of any length needs bounded memory.
SLICE = 1 << 16
#: Fingerprints that one shard holds on average, most that one task searches, and most sampled for the top tree.
SHARD = 6000
HOT = 30_000
SAMPLE = 100_000
LEAF = 48


def _mixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from each hash (the finaliser of splitmix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sketch(text: str | None, width: int = 3, blocks: int = 1) -> bytes:
    """The fingerprint, 8 * blocks bytes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return bytes(8 * blocks)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    span = min(width, len(words)) - 1
    ones = np.zeros(64 * blocks, np.int64)
    for at in range(0, n, SLICE):
        to = min(at + SLICE, n)
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at:to].tolist(), ends[at + span : to + span].tolist())), np.uint64, to - at)
        ones += votes(hashes, blocks)
    return majority(ones, n)


def votes(hashes: np.ndarray, blocks: int = 1) -> np.ndarray:
    """How many of the hashes, SLICE at most, have each bit set."""
    ones = np.zeros(64 * blocks, np.int64)
    for block in range(blocks):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # bytes can't overflow within 255 rows
            ones[64 * block : 64 * block + 64] += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
        if block + 1 < blocks:
            hashes = _mixed(hashes)
    return ones


def majority(ones: np.ndarray, n: int) -> bytes:
    """The fingerprint: bits set in over half of n hashes."""
    return np.packbits(ones * 2 > n, bitorder="little").view("<u8").astype(">u8").tobytes()


def fingerprint(text: str | None, width: int = 3) -> int:
    return int.from_bytes(sketch(text, width), "big")


def fingerprints(docs: DataFrame, width: int = 3, blocks: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (binary), one row per row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [sketch(t, width, blocks) for t in b["text"]]})

    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return chosen.mapInPandas(run, "doc_id string, fp binary").withColumn("doc_id", F.col("doc_id").cast(kind))


def unpacked(fps) -> np.ndarray:
    """Fingerprints as rows of 64-bit words."""
    fps = list(fps)
    return np.frombuffer(b"".join(fps), ">u8").astype(np.uint64).reshape(len(fps), -1) if fps else np.zeros((0, 1), np.uint64)


def packed(points: np.ndarray) -> list[bytes]:
    return [p.tobytes() for p in points.astype(">u8")]


def distances(points: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Differing bits; broadcasts over all axes but the last."""
    return np.bitwise_count(points ^ pivot).sum(axis=-1, dtype=np.int16)


def top_tree(sample: np.ndarray, leaf: int) -> list[tuple]:
    """Nodes (vantage point, cut, inner, outer); a negative child -k-1 is shard k. [] for one shard.

    The vantage point is the one of a few candidates whose cut leaves the fewest points within
    the boundary, and so the fewest copies.
    """
    nodes: list[list] = []
    shards = 0
    rng = np.random.default_rng(SEED)

    def grow(points: np.ndarray) -> int:
        nonlocal shards
        best = None
        if len(points) > leaf:
            for k in rng.integers(0, len(points), 8):
                d = distances(points, points[k])
                cut = int(np.median(d))
                share = (d <= cut).mean()
                if 0.1 <= share <= 0.9:
                    near = (np.abs(d - cut) <= 3).mean() + abs(share - 0.5)
                    if best is None or near < best[0]:
                        best = (near, points[k], cut, d)
        if best is None:
            shards += 1
            return -shards
        _, pivot, cut, d = best
        at = len(nodes)
        nodes.append([pivot, cut, 0, 0])
        nodes[at][2] = grow(points[d <= cut])
        nodes[at][3] = grow(points[d > cut])
        return at

    grow(sample)
    return [tuple(n) for n in nodes]


def route(points: np.ndarray, nodes: list, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of point, shard, whether it is the point's home) for every shard that a point must be in."""
    if not nodes:
        return np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
    out, todo = [], [(0, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, index, home = todo.pop()
        if not len(index):
            continue
        if at < 0:
            out.append((index, np.full(len(index), -at - 1, np.int64), home))
            continue
        pivot, cut, inner, outer = nodes[at]
        d = distances(points[index], pivot)
        inside, outside = d <= cut + radius, d > cut - radius
        todo += [(inner, index[inside], home[inside] & (d[inside] <= cut)), (outer, index[outside], home[outside] & (d[outside] > cut))]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


class Forest:
    """Union-find by index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def shard_links(points: np.ndarray, home: np.ndarray, radius: int, seek: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs: a spanning forest of all links between a home point and any point of the shard, or of seek.

    A tree is grown over the home points while those points search it: a node sends a query to the
    side that its distance allows, and to both within the radius of the cut.
    """
    forest = Forest(len(points))
    left, right = [], []
    todo = [(np.flatnonzero(home), np.arange(len(points)) if seek is None else np.flatnonzero(seek))]
    while todo:
        own, queries = todo.pop()
        if not len(own) or not len(queries):
            continue
        split = False
        if len(own) > LEAF:
            pivot = points[own[len(own) // 2]]
            d_own, d_query = distances(points[own], pivot), distances(points[queries], pivot)
            cut = int(np.median(d_own))
            split = 0 < (d_own <= cut).sum() < len(own)
        if split:
            todo.append((own[d_own <= cut], queries[d_query <= cut + radius]))
            todo.append((own[d_own > cut], queries[d_query > cut - radius]))
            continue
        for at in range(0, len(own), LEAF):  # a leaf, or equal distances that no cut tells apart
            part = own[at : at + LEAF]
            hit_own, hit_query = np.nonzero(distances(points[queries][None], points[part][:, None]) <= radius)
            for a, b in zip(part[hit_own].tolist(), queries[hit_query].tolist()):
                if a != b and forest.join(a, b):
                    left.append(a)
                    right.append(b)
    return np.array(left, np.int64), np.array(right, np.int64)


def pieced(rows: DataFrame, own) -> DataFrame:
    """rows with own, first and second: once for each pair of pieces (first <= second) that holds piece own.

    rows names the number of pieces of each row's group. A pair of pieces holds two pieces and no more.
    """
    other = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other")
    return rows.withColumn("own", own).select("*", other).withColumn("first", F.least("own", "other")).withColumn("second", F.greatest("own", "other")).drop("other")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that come sorted by keys; a group may run over several batches."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        changed = (batch[keys].to_numpy()[1:] != batch[keys].to_numpy()[:-1]).any(axis=1)
        bounds = [0, *(np.flatnonzero(changed) + 1).tolist(), len(batch)]
        for k, (i, j) in enumerate(zip(bounds, bounds[1:])):
            part = batch.iloc[i:j]
            if rest and (k or (rest[0][keys].iloc[0].to_numpy() != part[keys].iloc[0].to_numpy()).any()):
                yield pd.concat(rest)
                rest = []
            rest.append(part)
    if rest:
        yield pd.concat(rest)


def dealt_pieces(dealt: DataFrame) -> DataFrame:
    """shard, first, second, own, fp, home: what searched() compares, one group for each shard and pair of pieces."""
    sizes = dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = dealt.join(sizes, "shard").withColumn("pieces", F.ceil(F.col("n") / HOT).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    return pieced(sized, own).select("shard", "first", "second", "own", "fp", "home")


def searched(dealt: DataFrame, radius: int) -> DataFrame:
    """a, b: the forests of all shards of dealt (shard, fp, home)."""
    keys = ["shard", "first", "second"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in whole_groups(batches, keys):
            if len(group) < 2:
                continue
            fps = group["fp"].tolist()
            points, home, own = unpacked(fps), group["home"].to_numpy(bool), group["own"].to_numpy()
            first, second = own == group["first"].iloc[0], own == group["second"].iloc[0]
            found = [shard_links(points, home & first, radius, second)]
            if group["first"].iloc[0] != group["second"].iloc[0]:
                found.append(shard_links(points, home & second, radius, first & ~home))
            for a, b in found:
                if len(a):
                    yield pd.DataFrame({"a": [fps[i] for i in a], "b": [fps[i] for i in b]})

    return dealt_pieces(dealt).repartition(*keys).sortWithinPartitions(*keys, "fp").mapInPandas(search, "a binary, b binary")


def links(distinct: DataFrame, radius: int = 2, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """a, b: edges between distinct fingerprints that have the components of all links within the radius.

    sample bounds the fingerprints that the driver sees, and so the top tree that it broadcasts.
    """
    n = distinct.count()
    picked = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample) if n > shard else distinct.select("fp").limit(0)
    points = unpacked(r[0] for r in picked.collect())
    nodes = top_tree(points, max(2, int(shard * len(points) / n))) if n > shard else []
    tree = distinct.sparkSession.sparkContext.broadcast(nodes)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = b["fp"].to_numpy(object)
            index, to, home = route(unpacked(fps), tree.value, radius)
            yield pd.DataFrame({"shard": to, "fp": fps[index], "home": home})

    return searched(common.stored(distinct.select("fp").mapInPandas(deal, "shard long, fp binary, home boolean"), "simhash-dealt"), radius)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node of each node's component, for every node that has an edge.

    Each round, every node takes the least root among itself and its neighbours, then roots follow
    their own root (pointer jumping). It ends when nothing changes. Edges between nodes of one root
    are dropped and the others are lifted to roots, so that the graph shrinks with each round.
    """
    edges = common.stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    roots = common.stored(edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")), "cc-roots")
    for _ in range(most_rounds):
        if edges.isEmpty():
            return roots
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("from"), F.least("a", "low").alias("to"))
        least = common.stored(least, "cc-least")
        # Two jumps along the new pointers; each points to a smaller node, so there are no cycles.
        for _ in range(2):
            ahead = least.select(F.col("from").alias("at"), F.col("to").alias("next"))
            least = common.stored(least.join(ahead, F.col("to") == F.col("at"), "left").select("from", F.coalesce("next", "to").alias("to")), "cc-jump")
        moved = lambda frame, c: frame.join(least, F.col(c) == F.col("from"), "left").withColumn(c, F.coalesce("to", c)).drop("from", "to")
        roots = common.stored(moved(roots, "root"), "cc-roots")
        lifted = moved(moved(edges, "a"), "b").where("a <> b")
        edges = common.stored(lifted.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")


def near_dedup(docs: DataFrame, width: int = 3, radius: int = 2, blocks: int = 1, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id, one row per row of docs."""
    marked = common.stored(fingerprints(docs, width, blocks, id_col, text_col), "simhash-fp")
    # Equal fingerprints are one node.
    classes = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-classes")
    roots = components(links(classes, radius, shard))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    member = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return marked.join(member, "fp").select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs but for all but one of each component: the smallest doc_id stays (null last), then the first row.

    Components are those of shingle_join (SimHash links, checked by five-word shingles at a Jaccard similarity of 0.8, and
    an exact join for the rest). Rows are told apart by their place, so that ids may repeat or be null.
    """
    from . import shingle_join  # it builds on this module

    scan, _ = common.on_file(docs, "simhash-docs")
    rows = common.stored(shingle_join.near_rows(scan), "simhash-rows")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "file", "row")
    least = rows.groupBy("root").agg(F.min(place).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = common.small(common.stored(least, "simhash-least"))
    return common.without_rows(scan, rows.join(least, "root").where(place != F.col("least")).select("file", "row"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
