"""Boosted trees of all folds at once, where a fold's rows are too many for one task.

The same trees as functions.boosting makes: cut points at the exact quantiles of a fold's training rows (trees take no note of
a column's scale), and for each level of each round the sums of gradients by fold, class, node and bin. Tasks add up whole
numbers, so that neither the order of rows nor their partitions show in a tree; a task holds a batch of rows and its sums.
The driver holds counts of a few thousand intervals a column, and trees.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boosting import softmax

#: Intervals in which a column's values are counted at a time, and values that the driver may ask for in the end.
EDGES = 4096
VALUES = 500_000
#: Rows that are added up at a time, and bits of a gradient's fraction.
BATCH = 8192
BITS = 36
#: Values of x in a file of the stored table.
CELLS = 8_000_000


@dataclass
class Fold:
    """A fold's classes, cut points (a list a column, as places among all folds' cuts) and trees, grown round by round."""

    fold: int
    classes: np.ndarray
    start: np.ndarray
    rows: int
    cuts: list[np.ndarray] = field(default_factory=list)
    #: bins[j * width + place among all folds' cuts]: j * most + place among the fold's own.
    bins: np.ndarray | None = None
    trees: list[tuple[int, dict]] = field(default_factory=list)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the folder that driver and executors share and read back; the cluster clears it."""
    spark = df.sparkSession
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    path = (named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/rotorlens-scratch").rstrip("/") + f"/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


# -- cut points ------------------------------------------------------------------------------------------------
def keys_of(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the finite values."""
    bits = (x + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(2**63 - 1))


def values_of(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & np.int64(2**63 - 1))).view(np.float64)


def _matrix(column, width: int) -> np.ndarray:
    """An array column of an Arrow batch, with nulls as NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(flat) != len(column) * width or column.null_count:
        raise ValueError(f"every row needs {width} values")
    return flat.reshape(-1, width)


def _kinds(column, kinds: dict[str, int]) -> np.ndarray:
    d = column.dictionary_encode()
    return np.array([kinds[s] for s in d.dictionary.to_pylist()], np.int64)[d.indices.to_numpy()]


def _summed(base: DataFrame, names: list[str], count: Callable, keyed: Callable, schema: str) -> list:
    """count(batch) adds a batch to arrays by key and returns them; keyed(key, sum) makes the result's rows of a key's sum."""
    tasks = 4 * base.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                count(whole.slice(at, BATCH), sums)
        for k, x in sums.items():
            yield pa.RecordBatch.from_pydict({"key": pa.array([k], pa.int64()), "x": pa.array([x.tobytes()], pa.binary())})

    def add(key, d: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(d["x"].iloc[0], np.int64).copy()
        for x in d["x"].iloc[1:]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame(keyed(int(key[0]), total), columns=[c.split()[0] for c in schema.split(", ")])

    return base.select(*names).coalesce(tasks).mapInArrow(run, "key long, x binary").groupBy("key").applyInPandas(add, schema).collect()


def order_statistics(base: DataFrame, kinds: dict[str, int], width: int, wanted: list[list[tuple[np.ndarray, np.ndarray]]]) -> list[list[np.ndarray]]:
    """The values at some ranks, exactly. wanted[j]: for column j, (kinds that count, ranks) of each fold.

    Rows are counted by column, kind and interval; intervals that hold a wanted rank are split until they hold one value, or
    until the rows inside are few enough to be asked for.
    """
    low, high = -(2**63) + 1, 2**63 - 1
    # Each column's intervals: edges[i] <= key < edges[i + 1]; the last one is open.
    edges = [np.array([low + (high - low) * k // EDGES for k in range(EDGES)], np.int64)] * width
    n_kinds = len(kinds)
    while True:

        def count(batch, sums: dict, edges=edges) -> None:
            x, kind = keys_of(_matrix(batch.column(0), width)), _kinds(batch.column(1), kinds)
            for j, e in enumerate(edges):
                n = len(e) + 1
                found = np.bincount(kind * n + np.searchsorted(e, x[:, j], "right"), minlength=n_kinds * n).astype(np.int64)
                sums[j] = sums[j] + found if j in sums else found

        counts = {r["j"]: np.frombuffer(r["n"], np.int64).reshape(n_kinds, -1)[:, 1:] for r in _summed(base, ["x", "sig"], count, lambda j, x: [(j, x.tobytes())], "j long, n binary")}
        active, inside = [], 0
        for j in range(width):
            hit = [np.unique(np.searchsorted(np.cumsum(counts[j][own].sum(0)), ranks, "right")) for own, ranks in wanted[j]]
            hit = np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
            ends = np.append(edges[j][1:], high)
            hit = hit[ends[hit].astype(object) - edges[j][hit].astype(object) > 1] if len(hit) else hit
            active.append([(int(edges[j][i]), int(ends[i])) for i in hit])
            inside += int(counts[j][:, hit].sum())
        if inside <= VALUES:
            break
        edges = [_split(a, edges[j], wanted[j], counts[j]) for j, a in enumerate(active)]
    rest = _inside(base, kinds, width, active) if inside else {}
    out = []
    for j in range(width):
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        kind, key = rest.get(j, none)
        found = []
        for own, ranks in wanted[j]:
            through = np.cumsum(counts[j][own].sum(0))
            at = np.searchsorted(through, ranks, "right")
            values = edges[j][at].copy()
            mine = np.sort(key[np.isin(kind, own)])
            for a, b in active[j]:
                i = int(np.searchsorted(edges[j], a))
                here = at == i
                if here.any():
                    held = mine[np.searchsorted(mine, a) : np.searchsorted(mine, b)]
                    values[here] = held[ranks[here] - (through[i - 1] if i else 0)]
            found.append(values_of(values))
        out.append(found)
    return out


def _split(active: list[tuple[int, int]], edges: np.ndarray, wanted: list, counts: np.ndarray) -> np.ndarray:
    """Edges of the next count: those of the intervals that are settled but hold a wanted rank, and the parts of the others."""
    kept = {int(edges[0])}
    for own, ranks in wanted:
        for i in np.unique(np.searchsorted(np.cumsum(counts[own].sum(0)), ranks, "right")):
            kept.add(int(edges[i]))
            if i + 1 < len(edges):
                kept.add(int(edges[i + 1]))
    parts = max(2, EDGES // max(1, len(active)))
    for a, b in active:
        kept.update(a + (b - a) * k // parts for k in range(parts))
    return np.array(sorted(kept), np.int64)


def _inside(base: DataFrame, kinds: dict[str, int], width: int, active: list[list[tuple[int, int]]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Kinds and keys of the values in some intervals of each column."""
    bounds = [np.array(a, np.int64).reshape(-1, 2) for a in active]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x, kind = keys_of(_matrix(b.column(0), width)), _kinds(b.column(1), kinds)
            for j, e in enumerate(bounds):
                if len(e):
                    i = np.searchsorted(e[:, 0], x[:, j], "right") - 1
                    some = (i >= 0) & (x[:, j] < e[i, 1])
                    if some.any():
                        yield pa.RecordBatch.from_pydict({"j": np.full(some.sum(), j), "kind": kind[some], "key": x[some, j]})

    d = base.select("x", "sig").mapInArrow(run, "j long, kind long, key long").toPandas()
    return {j: (g["kind"].to_numpy(), g["key"].to_numpy()) for j, g in d.groupby("j")}


def cut_points(base: DataFrame, kinds: dict[str, int], width: int, trains: list[np.ndarray], rows: list[int], usable: np.ndarray, most: int) -> list[list[np.ndarray]]:
    """np.unique(np.quantile(column, k / most)) of each fold's training rows, for each column; none for columns that are not usable.

    trains: the kinds that train each fold; rows: how many rows that are; usable: fold, column.
    """
    share = np.arange(1, most) / most
    at = [(n - 1) * share for n in rows]
    ranks = [np.concatenate((np.floor(a), np.minimum(np.floor(a) + 1, n - 1))).astype(np.int64) for a, n in zip(at, rows)]
    wanted = [[(own, r) for k, (own, r) in enumerate(zip(trains, ranks)) if usable[k, j]] for j in range(width)]
    found = order_statistics(base, kinds, width, wanted)
    cuts: list[list[np.ndarray]] = [[np.zeros(0)] * width for _ in trains]
    for j in range(width):
        for k, x in zip(np.flatnonzero(usable[:, j]), found[j]):
            a, b, t = x[: most - 1], x[most - 1 :], at[k] - np.floor(at[k])
            cuts[k][j] = np.unique(np.where(t >= 0.5, b - (b - a) * (1 - t), a + (b - a) * t))  # as NumPy does it
    return cuts


# -- trees -----------------------------------------------------------------------------------------------------
def _nodes(tree: dict, codes: np.ndarray, depth: int) -> np.ndarray:
    """The node of each row after `depth` levels, numbered as in a heap from 1; a row stays in a leaf."""
    at, row = np.ones(len(codes), np.int64), np.arange(len(codes))
    for _ in range(depth):
        column = tree["column"][at]
        inner = column >= 0
        at = np.where(inner, 2 * at + (codes[row, column] > tree["cut"][at]), at)
    return at


def _scores(f: Fold, codes: np.ndarray, depth: int, rate: float) -> np.ndarray:
    scores = np.tile(f.start, (len(codes), 1))
    for c, tree in f.trees:
        scores[:, c] += rate * tree["value"][_nodes(tree, codes, depth)]
    return scores


def _best(n: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], l2: float, least: int) -> tuple | None:
    """(column, place, sums on the left, all) of a node's best split; n, g, h: column, bin."""
    rows, total_g, total_h = n[0].sum(), g[0].sum(), h[0].sum()
    if rows < 2 * least:
        return None
    size, left_g, left_h = (x[:, :-1].cumsum(1) for x in (n, g, h))
    gain = left_g**2 / (left_h + l2) + (total_g - left_g) ** 2 / (total_h - left_h + l2) - total_g**2 / (total_h + l2)
    gain[(size < least) | (rows - size < least) | (np.arange(gain.shape[1]) >= np.array([len(c) for c in cuts])[:, None])] = -1
    j, k = np.unravel_index(int(gain.argmax()), gain.shape)
    return (int(j), int(k), float(left_g[j, k]), float(left_h[j, k])) if gain[j, k] > 1e-9 else None


def _grown(base: DataFrame, folds: list[Fold], roles: np.ndarray, kinds: dict[str, int], codes_of: Callable, depth: int, rate: float, l2: float, least: int, most: int, width: int) -> None:
    """One more round in every fold. roles: kind, fold; 1 trains."""
    bits = min(BITS, 62 - max(f.rows for f in folds).bit_length())
    unit = 2.0**bits
    new = {}
    for k, f in enumerate(folds):
        for c in [1] if len(f.classes) == 2 else range(len(f.classes)):
            new[k, c] = {"column": np.full(2 ** (depth + 1), -1, np.int64), "cut": np.zeros(2 ** (depth + 1), np.int64), "value": np.zeros(2 ** (depth + 1))}
    most_classes = max(len(f.classes) for f in folds)
    for level in range(max(depth, 1)):
        first, wide = 2**level, 2**level * width * most
        growing = dict(new) if not level else {at: t for at, t in new.items() if (t["column"][first // 2 : first] >= 0).any()}
        if not growing:
            break

        def count(batch, sums: dict, level=level, first=first, wide=wide, growing=growing) -> None:
            codes, truth, kind = codes_of(batch.column(0)), batch.column(1).to_numpy(), _kinds(batch.column(2), kinds)
            for k, f in enumerate(folds):
                some = roles[kind, k] == 1
                mine = [c for at, c in growing if at == k]
                if not mine or not some.any():
                    continue
                x, y = codes[some], np.searchsorted(f.classes, truth[some])
                p = softmax(_scores(f, x, depth, rate))
                bins = f.bins[np.arange(width) * (len(f.bins) // width) + x]
                for c in mine:
                    node = _nodes(growing[k, c], x, level) - first
                    live = np.flatnonzero(node >= 0)
                    q = p[live, c]
                    g, h = q - (y[live] == c), np.maximum(q * (1 - q), 1e-16)
                    at = (bins[live] + node[live, None] * (width * most)).ravel()
                    found = [np.bincount(at, minlength=wide), *(np.bincount(at, np.repeat(np.rint(v * unit), width), wide) for v in (g, h))]
                    found = np.concatenate(found).astype(np.int64)
                    key = k * most_classes + c
                    sums[key] = sums[key] + found if key in sums else found

        def split(key: int, total: np.ndarray, first=first) -> list[tuple]:
            cuts = folds[key // most_classes].cuts
            n, g, h = total.reshape(3, first, width, most)
            g, h = g / unit, h / unit
            out = []
            for i in range(first):
                found = _best(n[i], g[i], h[i], cuts, l2, least) if depth else None
                out.append((key, first + i, float(g[i, 0].sum()), float(h[i, 0].sum()), *(found or (-1, 0, 0.0, 0.0))))
            return out

        for r in _summed(base, ["code", "truth", "sig"], count, split, "key long, node long, g double, h double, column long, place long, left_g double, left_h double"):
            k, c = divmod(r["key"], most_classes)
            tree, at = new[k, c], r["node"]
            if not level:
                tree["value"][at] = -r["g"] / (r["h"] + l2)
            if r["column"] >= 0:
                tree["column"][at], tree["cut"][at] = r["column"], folds[k].cuts[r["column"]][r["place"]]
                tree["value"][2 * at] = -r["left_g"] / (r["left_h"] + l2)
                tree["value"][2 * at + 1] = -(r["g"] - r["left_g"]) / (r["h"] - r["left_h"] + l2)
    for (k, c), tree in new.items():
        folds[k].trees.append((c, tree))


def predictions(rows: DataFrame, n_rows: int, width: int, rounds: int, rate: float, depth: int, least: int, l2: float = 1.0, most: int = 64) -> DataFrame:
    """fold, row, truth, pred of every test row. rows: row, x (array<double>), truth (string), roles."""
    spark = rows.sparkSession
    sig = F.array_join(F.array_sort(F.transform("roles", lambda r: F.concat(r["fold"].cast("string"), F.lit(":"), r["role"]))), " ")
    files = max(spark.sparkContext.defaultParallelism, -(-n_rows * width // CELLS))
    base = stored(rows.select("row", "x", "truth", sig.alias("sig")).repartition(files, "row"), "protocol-rows")
    # A column with a value that is no number has no scale in the folds which that value trains, so it splits nothing there.
    finite = F.array(*[F.sum(F.when(F.isnan(v := F.coalesce(F.get("x", F.lit(j)), F.lit(float("nan")))) | (F.abs(v) == float("inf")), 1).otherwise(0)) for j in range(width)])
    met = base.groupBy("sig", "truth").agg(F.count(F.lit(1)).alias("n"), finite.alias("odd")).collect()  # a row a kind and label
    if any(r["truth"] is None for r in met):
        raise ValueError("rows without a label")
    labels = sorted({r["truth"] for r in met})
    kinds = {s: k for k, s in enumerate(sorted({r["sig"] for r in met}))}
    role_of = [dict((int(a), b) for a, b in (x.split(":", 1) for x in s.split())) for s in kinds]
    number = sorted({f for r in role_of for f in r})
    every = np.array([[{"train": 1, "test": 2}.get(r.get(f), 0) for f in number] for r in role_of]).reshape(len(kinds), len(number))
    n, odd = np.zeros((len(kinds), len(labels)), np.int64), np.zeros((len(kinds), width), np.int64)
    for r in met:
        n[kinds[r["sig"]], labels.index(r["truth"])] += r["n"]
        odd[kinds[r["sig"]]] += np.array(r["odd"], np.int64)
    folds, chosen = [], []
    for k, f in enumerate(number):
        counts = n[every[:, k] == 1].sum(0)
        classes = np.flatnonzero(counts)
        if len(classes) > 1 and (every[:, k] == 2).any():
            share = counts[classes] / counts.sum()
            folds.append(Fold(f, classes, np.log(np.maximum(share, 1e-12)), int(counts.sum())))
            chosen.append(k)
    if not folds:
        dropped(base)
        return spark.createDataFrame([], "fold long, row long, truth string, pred string")
    roles = every[:, chosen]
    trains = [np.flatnonzero(roles[:, k] == 1) for k in range(len(folds))]
    usable = np.array([odd[own].sum(0) == 0 for own in trains])
    cuts = cut_points(base, kinds, width, trains, [f.rows for f in folds], usable, most)
    joint = [np.unique(np.concatenate([c[j] for c in cuts])) for j in range(width)]
    wide = max(len(c) for c in joint) + 1
    for f, own in zip(folds, cuts):
        f.cuts = [np.searchsorted(joint[j], own[j]) for j in range(width)]
        f.bins = np.concatenate([j * most + np.searchsorted(f.cuts[j], np.arange(wide), "left") for j in range(width)]).astype(np.int64)
    kind_of = np.dtype(np.uint16 if wide < 2**16 else np.uint32)

    def coded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = _matrix(b.column(1), width)
            codes = np.stack([np.searchsorted(c, v, "right") for c, v in zip(joint, x.T)], axis=1).astype(kind_of)
            truth = b.column(2).dictionary_encode()
            truth = np.array([labels.index(s) for s in truth.dictionary.to_pylist()], np.int64)[truth.indices.to_numpy()]
            yield pa.RecordBatch.from_pydict({"row": b.column(0), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "truth": pa.array(truth), "sig": b.column(3)})

    def codes_of(column) -> np.ndarray:
        # np.int64: these are places in tables of bins.
        return np.frombuffer(b"".join(column.to_pylist()), kind_of).reshape(-1, width).astype(np.int64)

    places = stored(base.mapInArrow(coded, "row long, code binary, truth long, sig string"), "protocol-places")
    dropped(base)
    for _ in range(rounds):
        _grown(places, folds, roles, kinds, codes_of, depth, rate, l2, least, most, width)

    def predicted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            codes, truth, kind = codes_of(b.column(1)), b.column(2).to_numpy(), _kinds(b.column(3), kinds)
            row = b.column(0).to_numpy()
            for k, f in enumerate(folds):
                some = np.flatnonzero(roles[kind, k] == 2)
                if len(some):
                    pred = f.classes[softmax(_scores(f, codes[some], depth, rate)).argmax(1)]
                    name = lambda at: pa.array([labels[i] for i in at], pa.string())
                    yield pa.RecordBatch.from_pydict({"fold": np.full(len(some), f.fold, np.int64), "row": row[some], "truth": name(truth[some]), "pred": name(pred)})

    return places.mapInArrow(predicted, "fold long, row long, truth string, pred string")
