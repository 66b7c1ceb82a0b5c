"""Queries on array kernels and models; SQL cannot state them, so tests hold them against planted truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import kernels
from ..sources import views
from .registering import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


def _waves(spark, d):
    """One row per recording: its samples in order."""
    return views.user_signals(spark, d).groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("x"))


def _per_row(df, schema: str, make):
    def run(batches):
        for b in batches:
            rows = [row for rec, x in zip(b["rec"], b["x"]) for row in make(rec, np.asarray(x, float))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return df.mapInPandas(run, schema)


@query()
def envelope_spectrum(spark, d):
    make = lambda rec, x: [(rec, k, float(v)) for k, v in enumerate(kernels.order_spectrum(kernels.envelope(x, 64.0, 2.0, 28.0), 64.0, 1.5, 32))] if len(x) >= 16 else []
    return rounded(_per_row(_waves(spark, d), "rec long, bin long, v double", make))


@query()
def stft_ridge(spark, d):
    make = lambda rec, x: [(rec, float(t), float(f)) for t, f in zip(*kernels.ridge(x, 64.0, 0.25, 0.0625, 4.0, 30.0))]
    return rounded(_per_row(_waves(spark, d), "rec long, t double, hz double", make))


@query()
def decimated_signal(spark, d):
    make = lambda rec, x: [(rec, k, float(v)) for k, v in enumerate(kernels.decimate(x, 4))] if len(x) >= 8 else []
    return rounded(_per_row(_waves(spark, d), "rec long, n long, x double", make))


@query()
def cnn_forward(spark, d):
    """Integer convolution, pooling and a linear layer with fixed seeded weights; class by first maximum."""
    rng = np.random.default_rng(0)
    w, b, fc = rng.integers(-127, 128, (8, 1, 5)), rng.integers(-500, 500, 8), rng.normal(size=(3, 8))

    def make(rec, x):
        pooled = kernels.int8_conv(x[None], w, b, np.full(8, 0.01), 0.02).mean(1)
        logits = fc @ pooled
        return [(rec, int(logits.argmax()), float(logits.max()))]

    rows = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("rec"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return rounded(_per_row(rows, "rec long, label long, logit double", make))


@query()
def forest_protocol(spark, d):
    """Accuracy of a random forest on held-out groups, three group folds (a seeded learner, so no SQL)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = views.table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 29).alias("grp"), F.col("label").cast("double").alias("label"), array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    out = None
    for fold in range(3):
        model = RandomForestClassifier(numTrees=20, maxDepth=5, seed=fold).fit(rows.where(f"grp % 3 <> {fold}"))
        scored = model.transform(rows.where(f"grp % 3 = {fold}")).agg(F.lit(fold).alias("fold"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))
        out = scored if out is None else out.unionByName(scored)
    return rounded(out)
