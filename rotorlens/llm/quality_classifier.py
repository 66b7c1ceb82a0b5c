"""Quality classifier by co-training two views of a document.

The text view sees what a text is made of: the strongest evidence that any of its hashed words gives, and
shares of letters, capitals, digits, marks, repeated words and lines. The metadata view sees what comes with it:
source, language, both together, the stated length, and how that compares with the text's. Each is a logistic
regression. A word's evidence is the log of how much more often bad documents have it than good ones; a document
is counted out of the evidence it is learnt with, and the regression gets the strongest word and the three
strongest, so that a few telling words count in a long text as in a short one.

The views start from labelled documents. In each round each view ranks all unlabelled documents and marks those it
is surest of, of both kinds in the shares of the labels, and the other learns from the marks. How sure a view may
be is measured, not assumed: a mark weighs what the marking view gains over guessing among its surest documents
of that kind that are labelled and that neither view has learnt from, so a view that knows little teaches little.
At the end each view is calibrated on those documents, and the two log odds are added, weighted by how well each
does there. All documents are scored, whole.

Labels: a bounded sample, the LABELLED documents of the smallest hashes of doc_id; of a doc_id that stands in several
rows, one. What is marked comes from all documents without a label; per_round of them each round, by parameter. A
document is good if its label says quality 1 and, where toxic is known, toxic 0. The driver sees features of the
labelled and marked documents, never texts.

Rejection: a document is rejected if its combined probability of being good is under the threshold, which
is set on the calibration documents so that at most `false_rejects` of the good ones go.

Defined cases: null texts count as empty; null metadata is a value of its own; labels that are null or whose
document is missing are not used; repeated labels count each; without labels of both kinds all documents get
the probability 0.5 and none is rejected; rows that repeat are scored each on its own; an empty table gives
an empty result; keep_good() keeps all columns, whatever they are called.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LABELLED = 6000
L2 = 1e-4
#: Rows in which a hashed word or value must occur to get a weight.
MIN_ROWS = 10
#: Rows in which a word must occur, besides the row in question, to be evidence.
LEAST_ROWS = 5
SHAPE, WORDS, META = 13, 1 << 18, 1 << 10
BARE = re.compile(r"[^a-zà-ÿ]+")


@lru_cache(maxsize=60_000)
def _slot(word: str) -> int:
    """Where a word without its marks is counted; words that differ in case or marks only share a place."""
    bare = BARE.sub("", word.lower())
    return zlib.crc32(bare.encode()) % WORDS if bare else -1


def text_view(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Shape numbers, and the places of the hashed words that occur."""
    text = text or ""
    n = max(1, len(text))
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    ascii_text = text.encode("ascii", "ignore").decode()
    marks = len(re.findall(r"[^\w\s]", text))
    tops = counts.most_common(1)[0][1] if words else 0
    shape = np.array([
        1.0, np.log1p(m), len(re.findall(r"[A-Z]", text)) / n * 5, len(re.findall(r"[0-9]", text)) / n * 5, marks / n * 5,
        len(re.findall(r"[#$%&*|<>{}\\^~=+_@]", text)) / n * 10, len(re.findall(r"[!?]", text)) / n * 10, len(counts) / m, tops / m,
        sum(map(len, counts)) / max(1, len(counts)) / 10, (1 - len(set(lines)) / len(lines)) if lines else 0.0, len(ascii_text) / n,
        len(re.findall(r"[^\w\s]{2,}", text)) / m,
    ])
    slots = {k for w in counts if (k := _slot(w)) >= 0}
    return shape, np.fromiter(slots, np.int64, len(slots))


def meta_view(source: str | None, lang: str | None, n_chars: int | None, length: int) -> np.ndarray:
    """Places of a document's metadata; lengths count by size class."""
    size = lambda n: -1 if n is None or n != n else int(np.log2(max(1, n)) * 2)
    gap = None if n_chars is None or n_chars != n_chars else size(n_chars) - size(length)
    named = (("source", source), ("lang", lang), ("size", size(n_chars)), ("lang+size", (lang, size(n_chars))), ("source+lang", (source, lang)), ("gap", gap))
    return np.array([zlib.crc32(f"{k}={v}".encode()) % META for k, v in named], np.int64)


class Rows:
    """Sparse rows: some dense numbers each, and places that are 1."""

    def __init__(self, dense: list, places: list, width: int):
        self.dense = np.array(dense, float).reshape(len(places), -1 if len(places) else 1)
        self.places, self.width = places, width

    def take(self, index) -> "Rows":
        return Rows(self.dense[index], [self.places[i] for i in index], self.width)

    def __add__(self, other: "Rows") -> "Rows":
        return Rows(np.vstack([self.dense, other.dense]), self.places + other.places, self.width)

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(self.places)), [len(p) for p in self.places]), np.concatenate([*self.places, np.zeros(0, np.int64)]).astype(np.int64)


class Linear:
    """A logistic regression over Rows, by full-batch AdaGrad from zero; deterministic."""

    def __init__(self, rows: Rows, y: np.ndarray, weight: np.ndarray, l2: float, steps: int = 250, rate: float = 0.3):
        self.mean, self.scale = rows.dense.mean(0), np.maximum(rows.dense.std(0), 1e-6)
        x = (rows.dense - self.mean) / self.scale
        row, place = rows.flat()
        # A place that few rows share would be learnt by heart; it keeps the weight 0.
        common = np.bincount(place, minlength=rows.width)[place] >= MIN_ROWS
        row, place = row[common], place[common]
        n = len(y)
        self.bias, self.w, self.v = 0.0, np.zeros(x.shape[1]), np.zeros(rows.width)
        seen = [1e-8, np.full(x.shape[1], 1e-8), np.full(rows.width, 1e-8)]
        for _ in range(steps):
            z = self.bias + x @ self.w + np.bincount(row, self.v[place], n)
            e = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / weight.sum()
            grads = [e.sum(), x.T @ e + l2 * self.w, np.bincount(place, e[row], rows.width) + l2 * self.v]
            for k, g in enumerate(grads):
                seen[k] = seen[k] + g * g
            self.bias -= rate * grads[0] / np.sqrt(seen[0])
            self.w = self.w - rate * grads[1] / np.sqrt(seen[1])
            self.v = self.v - rate * grads[2] / np.sqrt(seen[2])

    def logits(self, rows: Rows) -> np.ndarray:
        row, place = rows.flat()
        return self.bias + (rows.dense - self.mean) / self.scale @ self.w + np.bincount(row, self.v[place], len(rows.places))


class TextView:
    """A Linear over a text's shape and the evidence of its words."""

    def __init__(self, rows: Rows, y: np.ndarray, weight: np.ndarray, trust: np.ndarray):
        row, place = rows.flat()
        self.bad = np.bincount(place, (trust * (y < 0.5))[row], rows.width).astype(np.float32)
        self.good = np.bincount(place, (trust * (y > 0.5))[row], rows.width).astype(np.float32)
        self.n_bad, self.n_good = float((trust * (y < 0.5)).sum()), float((trust * (y > 0.5)).sum())
        self.odds = self._odds(self.bad, self.good).astype(np.float32)
        self.linear = Linear(self._joined(rows, y, trust), y, weight * trust, L2)

    def _odds(self, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        odds = np.log((np.maximum(bad, 0) + 0.5) / (self.n_bad + 1)) - np.log((np.maximum(good, 0) + 0.5) / (self.n_good + 1))
        return np.where(bad + good < LEAST_ROWS - 1e-3, 0, odds)

    def _joined(self, rows: Rows, y: np.ndarray | None = None, trust: np.ndarray | None = None) -> Rows:
        """y: the kinds of rows that were learnt from; each is counted out of its own evidence."""
        strongest = np.zeros((len(rows.places), 2))
        for i, p in enumerate(rows.places):
            if not len(p):
                continue
            if y is None:
                odds = self.odds[p]
            else:
                odds = self._odds(self.bad[p] - trust[i] * (y[i] < 0.5), self.good[p] - trust[i] * (y[i] > 0.5))
            top = np.partition(odds, len(odds) - 3)[-3:] if len(odds) > 3 else odds
            strongest[i] = top.max(), top.sum()
        # The words themselves are left out: a weight for each would learn the labelled texts by heart.
        return Rows(np.hstack([rows.dense, strongest]), [np.zeros(0, np.int64)] * len(rows.places), 1)

    def logits(self, rows: Rows) -> np.ndarray:
        return self.linear.logits(self._joined(rows))


class MetaView(Linear):
    def __init__(self, rows: Rows, y: np.ndarray, weight: np.ndarray, trust: np.ndarray):
        super().__init__(rows, y, weight * trust, L2)


FEATURES = "__rl_shape binary, __rl_words binary, __rl_meta binary"


def features(docs: DataFrame, carried: list[str]) -> DataFrame:
    """carried columns of docs, whatever their types, and the features of both views; texts are read once, here."""
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            made = [[], [], []]
            metas = zip(*[b.column(f"__rl_{n}").to_pylist() for n in ("source", "lang", "chars")])
            for value, meta in zip(b.column("__rl_text"), metas):  # one text becomes a Python object at a time
                text = value.as_py()
                shape, slots = text_view(text)
                for to, x in zip(made, (shape.astype(np.float32), slots.astype(np.int32), meta_view(*meta, len(text or "")).astype(np.int32))):
                    to.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in carried], *[pa.array(x, pa.binary()) for x in made]], [*carried, *names])

    chosen = docs.select(*carried, F.col("text").alias("__rl_text"), F.col("source").alias("__rl_source"), F.col("lang").alias("__rl_lang"), F.col("n_chars").cast("long").alias("__rl_chars"))
    schema = docs.select(*carried).schema
    for n in names:
        schema = schema.add(n, "binary")
    return chosen.mapInArrow(common.lean(run), schema)


def _views(shape, words, meta) -> list[Rows]:
    """The rows of both views from features()."""
    read = lambda values, kind: [np.frombuffer(x, kind) for x in values]
    return [Rows(read(shape, np.float32), [p.astype(np.int64) for p in read(words, np.int32)], WORDS), Rows([[1.0]] * len(meta), [p.astype(np.int64) for p in read(meta, np.int32)], META)]


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """Both views, their calibration and the threshold; some million numbers, whatever the input."""

    def __init__(self, views: list | None = None, calibration: Linear | None = None, threshold: float = 0.0, marks: list | None = None):
        self.views, self.calibration, self.threshold, self.marks = views, calibration, threshold, marks or []

    def logits(self, rows: list[Rows]) -> list[np.ndarray]:
        return [v.logits(r) for v, r in zip(self.views, rows)]

    def probability(self, rows: list[Rows]) -> list[np.ndarray]:
        n = len(rows[0].places)
        if self.views is None or not n:
            return [np.full(n, 0.5)] * 3
        both = self.logits(rows)
        return [*map(squash, both), squash(self.calibration.logits(_two(*both)))]


def _two(a: np.ndarray, b: np.ndarray) -> Rows:
    return Rows(np.stack([a, b], 1), [np.zeros(0, np.int64)] * len(a), 1)


def _weights(y: np.ndarray) -> np.ndarray:
    """Both kinds weigh the same in total."""
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    return np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)


def reliability(logits: np.ndarray, y: np.ndarray, share: float, good: bool) -> float:
    """What a view gains over guessing among its surest `share` (ten rows at least) of a kind: 0 nothing, 1 all."""
    sign = 1 if good else -1
    surest = np.argsort(-sign * logits, kind="stable")[: max(10, int(share * len(logits)))]
    right, base = (y[surest] > 0.5) == good, ((y > 0.5) == good).mean()
    return float(np.clip((right.mean() - base) / max(1 - base, 1e-6), 0, 1))


def co_train(labelled: list[Rows], y: np.ndarray, surest, rounds: int = 3, per_round: int = 300, false_rejects: float = 0.01) -> Model:
    """Both views of the labelled rows, in a fixed order, and whether each is good.

    surest(model, view, good, n) gives the rows of both views of the n unlabelled documents that the model's view
    is surest to be good (or bad) and that it has not given before, and the share of all unlabelled ones that they are.
    """
    fold = np.arange(len(y)) % 4 == 3  # a quarter is kept for calibration and trust
    if len(y) < 8 or len(set(y[fold])) < 2 or len(set(y[~fold])) < 2:
        return Model()
    learns, checks = np.flatnonzero(~fold), np.flatnonzero(fold)
    learnt = [[m.take(learns), y[learns], np.ones(len(learns))] for m in labelled]
    held, held_y = [m.take(checks) for m in labelled], y[checks]
    make = lambda: [kind(x, t, _weights(t), trust) for kind, (x, t, trust) in zip((TextView, MetaView), learnt)]
    model = Model(make())
    counts = [round(per_round * share) for share in (1 - y[learns].mean(), y[learns].mean())]
    for _ in range(rounds):
        told = []
        for view in (0, 1):
            known = model.views[view].logits(held[view])
            for good in (0, 1):
                rows, share = surest(model, view, bool(good), max(1, counts[good]))
                told.append((1 - view, good, rows, reliability(known, held_y, share, bool(good))))
        for other, good, rows, weight in told:  # what one view is sure of teaches the other
            n = len(rows[other].places)
            model.marks.append({"by": ("metadata", "text")[other], "good": bool(good), "rows": n, "weight": weight})
            if n:
                x, t, trust = learnt[other]
                learnt[other] = [x + rows[other], np.concatenate([t, np.full(n, good, np.float32)]), np.concatenate([trust, np.full(n, weight)])]
        model.views = make()
    both = _two(*model.logits(held))
    model.calibration = Linear(both, held_y, np.ones(len(checks)), 1e-5, 600)
    good = squash(model.calibration.logits(both))[held_y > 0.5]
    model.threshold = min(0.5, float(np.quantile(good, false_rejects)))
    return model


def _with_logits(made: DataFrame, model: Model) -> DataFrame:
    """doc_id, row and the logits of both views, for rows of features()."""
    shared = made.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a, m = shared.value.logits(_views(b["__rl_shape"], b["__rl_words"], b["__rl_meta"]))
            yield pd.DataFrame({"row": b["row"], "s0": a, "s1": m})

    return made.select("row", *FEATURE_NAMES).mapInPandas(common.lean(run), "row long, s0 double, s1 double")


FEATURE_NAMES = [x.split()[0] for x in FEATURES.split(", ")]


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, made: DataFrame | None = None, **how) -> Model:
    """A model from a bounded sample of labels and all unlabelled documents. made: stored features(docs, ["doc_id", "row"])."""
    if made is None:
        made = common.stored(features(docs.withColumn("row", F.monotonically_increasing_id()), ["doc_id", "row"]), "quality-features")
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").alias("__rl_id"), ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    order = F.md5(F.col("__rl_id").cast("string"))
    # Labels are chosen first; of a doc_id's rows the least features stand for it, so a repeated id stays one row.
    ids = made.select("doc_id").where("doc_id IS NOT NULL").distinct()
    picked = common.stored(marks.join(ids, F.col("__rl_id") == F.col("doc_id"), "left_semi").withColumn("o", order).orderBy("o", "good").limit(labelled), "quality-labels")
    chosen = picked.select("__rl_id").distinct()
    seen = made.join(F.broadcast(chosen), F.col("doc_id") == F.col("__rl_id")).groupBy("__rl_id").agg(F.min(F.struct(*FEATURE_NAMES)).alias("f"))
    rows = picked.join(seen, "__rl_id").select("o", "good", "f.*").toPandas().sort_values(["o", "good"], kind="stable")  # at most `labelled` rows
    y = rows["good"].to_numpy(np.float32)
    free = common.stored(made.select("row", F.col("doc_id")).join(marks.select("__rl_id").distinct(), F.col("doc_id") == F.col("__rl_id"), "left_anti").select("row"), "quality-unlabelled")
    n_free, given, scored = free.count(), set(), {}

    def surest(model: Model, view: int, good: bool, n: int) -> tuple[list[Rows], float]:
        if scored.get("views") is not model.views:  # once a round
            scored["views"] = model.views
            scored["rows"] = common.stored(_with_logits(made, model).join(free, "row", "left_semi"), "quality-logits", [scored["rows"]] if "rows" in scored else [])
        taken = scored["rows"].sparkSession.createDataFrame([(x,) for x in given], "row long") if given else free.limit(0)
        best = scored["rows"].join(F.broadcast(taken), "row", "left_anti").orderBy(F.desc(f"s{view}") if good else F.asc(f"s{view}"), "row").limit(n)
        own = [r["row"] for r in best.select("row").collect()]  # n rows, by parameter
        given.update(own)
        wanted = made.where(F.col("row").isin(own)).select("row", *FEATURE_NAMES).toPandas().sort_values("row") if own else rows.head(0)
        return _views(*[wanted[c] for c in FEATURE_NAMES]), len(own) / max(1, n_free)

    return co_train(_views(*[rows[c] for c in FEATURE_NAMES]), y, surest, **how)


SCORES = "p_text double, p_meta double, p_good double, rejected boolean"


def classify(made: DataFrame, model: Model, carried: list[str]) -> DataFrame:
    """carried columns of rows of features() with p_text, p_meta, p_good, rejected; one row per row."""
    shared = made.sparkSession.sparkContext.broadcast(model)
    names = [x.split()[0] for x in SCORES.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            p = shared.value.probability(_views(*[b.column(c).to_pylist() for c in FEATURE_NAMES]))
            new = [*map(pa.array, p), pa.array(p[2] < shared.value.threshold)]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in carried], *new], [*carried, *names])

    schema = made.select(*carried).schema
    for x in SCORES.split(", "):
        schema = schema.add(*x.split())
    return made.select(*carried, *FEATURE_NAMES).mapInArrow(common.lean(run), schema)


def scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, p_text, p_meta, p_good, rejected: one row per row of docs."""
    made = common.stored(features(docs.withColumn("row", F.monotonically_increasing_id()), ["doc_id", "row"]), "quality-features")
    return classify(made, fit(docs, labels, made=made, **how), ["doc_id"])


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that are not rejected, with the columns of docs."""
    scan, _ = common.on_file(docs, "quality-docs")
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    placed = scan.select("doc_id", "text", "source", "lang", "n_chars", at.alias("at"), F.monotonically_increasing_id().alias("row"))
    made = common.stored(features(placed, ["doc_id", "row", "at"]), "quality-features")
    return common.without_rows(scan, classify(made, fit(scan, labels, made=made, **how), ["at"]).where("rejected").select("at.file", "at.row"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
