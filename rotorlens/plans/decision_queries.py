"""Queries on splits, metrics, votes, fusion and quantisation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frames, fusion, metrics, quant, splits
from ..sources import views
from .registering import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

PRED = "WITH pr AS (SELECT l.doc_id, l.quality AS truth, l.toxic AS pred, d.source AS grp, d.lang AS rec FROM labels l JOIN documents d ON l.doc_id = d.doc_id) "
CLASSES = ", lb AS (SELECT unnest([0, 1, 2]) AS label), "
PER = "count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (truth <> label AND pred = label) AS fp, count(*) FILTER (truth = label AND pred <> label) AS fn"
F1 = "CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END"


@query(PRED + ", e AS (SELECT unnest([0, 1, 2]) AS truth), g AS (SELECT unnest([0, 1, 2]) AS pred) SELECT e.truth, g.pred, count(pr.doc_id) AS n FROM e CROSS JOIN g LEFT JOIN pr ON pr.truth = e.truth AND pr.pred = g.pred GROUP BY e.truth, g.pred")
def confusion_matrix(spark, d):
    return metrics.confusion(views.predictions(spark, d), [0, 1, 2])


@query(PRED + CLASSES + f"c AS (SELECT label, {PER} FROM lb CROSS JOIN pr GROUP BY label) SELECT CAST(label AS INTEGER) AS label, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN 1.0 * tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN 1.0 * tp / (tp + fn) ELSE 0 END, 6) AS recall, round({F1}, 6) AS f1, tp + fn AS support FROM c")
def class_report(spark, d):
    return rounded(metrics.per_class(views.predictions(spark, d), [0, 1, 2]))


@query(PRED + CLASSES + f"c AS (SELECT label, {PER} FROM lb CROSS JOIN pr GROUP BY label) SELECT round(avg({F1}), 6) AS macro_f1 FROM c")
def macro_f1(spark, d):
    return rounded(metrics.macro_f1(views.predictions(spark, d), [0, 1, 2]))


@query(PRED + CLASSES + f"c AS (SELECT grp, label, {PER} FROM lb CROSS JOIN pr GROUP BY grp, label), m AS (SELECT grp, avg({F1}) AS f FROM c GROUP BY grp) SELECT p.grp, count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0 END), 6) AS accuracy, round(any_value(f), 6) AS macro_f1 FROM pr p JOIN m ON p.grp = m.grp GROUP BY p.grp")
def scores_by_group(spark, d):
    return rounded(metrics.scores(views.predictions(spark, d), [0, 1, 2], ["grp"]))


@query(PRED + "SELECT grp, count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0 END), 6) AS accuracy FROM pr GROUP BY ROLLUP (grp)")
def score_by_group_rollup(spark, d):
    return rounded(views.predictions(spark, d).rollup("grp").agg(F.count(F.lit(1)).alias("n"), metrics.accuracy().alias("accuracy")))


@query(PRED + "SELECT rec, round(max(n) * 1.0 / sum(n), 6) AS baseline FROM (SELECT rec, truth, count(*) AS n FROM pr GROUP BY rec, truth) GROUP BY rec")
def majority_baseline(spark, d):
    return rounded(metrics.majority_baseline(views.predictions(spark, d), ["rec"]))


@query(PRED + "SELECT round(avg(r), 6) AS balanced_accuracy FROM (SELECT truth, avg(CASE WHEN truth = pred THEN 1.0 ELSE 0 END) AS r FROM pr GROUP BY truth)")
def balanced_accuracy(spark, d):
    return rounded(metrics.balanced_accuracy(views.predictions(spark, d)))


@query(PRED + "SELECT origin, count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0 END), 6) AS accuracy FROM (SELECT *, unnest(CASE WHEN truth = 1 THEN ['real', 'artificial'] WHEN doc_id % 2 = 0 THEN ['real'] ELSE ['artificial'] END) AS origin FROM pr) GROUP BY origin")
def overlapping_origin_scores(spark, d):
    both = F.when(F.col("truth") == 1, F.array(F.lit("real"), F.lit("artificial"))).when(F.col("doc_id") % 2 == 0, F.array(F.lit("real"))).otherwise(F.array(F.lit("artificial")))
    return rounded(views.predictions(spark, d).withColumn("origin", F.explode(both)).groupBy("origin").agg(F.count(F.lit(1)).alias("n"), metrics.accuracy().alias("accuracy")))


PROBS = "WITH p AS (SELECT label AS truth, vec_id % 40 AS rec, vec_id % 10 AS unit, vec_id, list_transform(embedding[1:4], lambda x: abs(CAST(x AS DOUBLE))) AS p FROM embeddings) "


def _probs(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("label").alias("truth"), (F.col("vec_id") % 40).alias("rec"), (F.col("vec_id") % 10).alias("unit"), "vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double"))).alias("p"))


@query(PROBS + ", m AS (SELECT rec, max(truth) AS truth, [avg(p[1]), avg(p[2]), avg(p[3]), avg(p[4])] AS m FROM p GROUP BY rec) SELECT rec, truth, CAST(list_position(m, list_max(m)) - 1 AS INTEGER) AS vote FROM m")
def recording_vote_soft(spark, d):
    return metrics.soft_vote(_probs(spark, d), 4)


@query(PRED + ", c AS (SELECT grp AS rec, pred, count(*) AS votes FROM pr GROUP BY grp, pred) SELECT rec, pred AS vote, votes FROM c QUALIFY row_number() OVER (PARTITION BY rec ORDER BY votes DESC, pred) = 1")
def recording_vote_hard(spark, d):
    return metrics.hard_vote(views.predictions(spark, d).select(F.col("grp").alias("rec"), "pred"))


@query()
def aggregation_curve(spark, d):
    rows = _probs(spark, d).select("unit", F.col("vec_id").alias("rec"), (F.col("truth") % 4).alias("truth"), "p")
    return rounded(metrics.aggregation_curve(rows, [1, 2, 5, 10], 20, 4))


@query("WITH v AS (SELECT vec_id AS rec, label, round(CAST(embedding[1] AS DOUBLE), 4) AS v FROM embeddings) SELECT a.rec, a.label, b.label AS pred FROM v a JOIN v b ON a.rec <> b.rec QUALIFY row_number() OVER (PARTITION BY a.rec ORDER BY abs(a.v - b.v), b.rec) = 1")
def knn1_loo(spark, d):
    return metrics.nearest_neighbour(views.table(spark, d, "embeddings").select(F.col("vec_id").alias("rec"), "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("v")))


@query("WITH s AS (SELECT l.*, count(*) OVER () AS all_n FROM labels l) SELECT quality AS run, round(avg(toxic), 6) AS mean, round(coalesce(stddev_samp(toxic), 0), 6) AS std, round(coalesce(stddev_samp(toxic), 0) / sqrt(count(*)), 6) AS sem, CAST(min(toxic) AS DOUBLE) AS low, CAST(max(toxic) AS DOUBLE) AS high FROM s GROUP BY quality")
def repeat_spread(spark, d):
    v = F.col("toxic")
    std = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return rounded(views.table(spark, d, "labels").groupBy(F.col("quality").alias("run")).agg(F.avg(v).alias("mean"), std.alias("std"), (std / F.sqrt(F.count(F.lit(1)))).alias("sem"), F.min(v).cast("double").alias("low"), F.max(v).cast("double").alias("high")))


@query("WITH r AS (SELECT quality AS run, avg(toxic) AS score FROM labels GROUP BY quality), a AS (SELECT avg(score) AS mean, coalesce(stddev_samp(score), 0) AS spread FROM r) SELECT mean > 0.05 AS above_floor, mean - 0.02 > spread AS beats_other FROM a")
def acceptance_test(spark, d):
    runs = views.table(spark, d, "labels").groupBy("quality").agg(F.avg("toxic").alias("score"))
    return runs.agg(F.avg("score").alias("m"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("s")).select((F.col("m") > 0.05).alias("above_floor"), (F.col("m") - 0.02 > F.col("s")).alias("beats_other"))


@query(PRED + "SELECT grp, count(*) AS n FROM pr WHERE truth <> pred GROUP BY grp")
def disagreements_by_group(spark, d):
    return views.predictions(spark, d).where("truth <> pred").groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


# -- splits ---------------------------------------------------------------------------------------------------
@query("SELECT CAST(row_number() OVER (ORDER BY held) - 1 AS BIGINT) AS fold, held FROM (SELECT DISTINCT vec_id % 29 AS held FROM embeddings)")
def logo_folds(spark, d):
    return splits.leave_one_group_out(_units(spark, d))


def _units(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("row"), (F.col("vec_id") % 29).alias("grp"), "label")


@query("WITH g AS (SELECT vec_id % 29 AS grp, count(*) AS n FROM embeddings GROUP BY 1), f AS (SELECT grp AS held, row_number() OVER (ORDER BY grp) - 1 AS fold FROM g) SELECT CAST(fold AS BIGINT) AS fold, grp, CASE WHEN grp = held THEN 'test' ELSE 'train' END AS role, n FROM f CROSS JOIN g")
def fold_balance(spark, d):
    rows = _units(spark, d)
    return splits.roles(rows, splits.leave_one_group_out(rows))


@query("SELECT vec_id % 29 AS grp, CAST(0 AS BIGINT) AS times FROM embeddings WHERE vec_id % 29 > 25 GROUP BY 1")
def verify_folds(spark, d):
    rows = _units(spark, d)
    return splits.verify_folds(splits.leave_one_group_out(rows.where("grp <= 25")), rows.select("grp").distinct())


@query("SELECT CAST(vec_id % 3 AS INTEGER) AS fold, vec_id % 29 AS grp FROM embeddings GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN vec_id % 4 = 0 THEN 'test' ELSE 'train' END) > 1")
def leak_check(spark, d):
    rows = _units(spark, d).select((F.col("row") % 3).cast("int").alias("fold"), "grp", F.when(F.col("row") % 4 == 0, "test").otherwise("train").alias("role"))
    return splits.leaks(rows)


@query("SELECT vec_id AS row, CASE WHEN label IN (2, 5) THEN 'test' ELSE 'train' END AS role FROM embeddings")
def holdout_condition(spark, d):
    return splits.holdout(_units(spark, d), F.col("label").isin(2, 5), "row")


@query("WITH p AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, round_even(count(*) OVER (PARTITION BY user_id) * CAST(0.7 AS DOUBLE), 0) AS cut FROM events) SELECT event_id, user_id, CASE WHEN i >= cut THEN 'test' WHEN i < cut - 5 THEN 'train' ELSE 'purged' END AS role FROM p")
def contiguous_block_purged(spark, d):
    return splits.contiguous_block(views.table(spark, d, "events"), 0.7, 5, "event_id", ["ts", "event_id"], ["user_id"])


@query("WITH p AS (SELECT vec_id AS row, label, row_number() OVER (PARTITION BY label ORDER BY md5('0:' || vec_id), vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings) SELECT row, label, CAST(CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1) ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // greatest(n // 5, 1) END AS BIGINT) AS fold FROM p")
def shuffled_folds(spark, d):
    return splits.shuffled(_units(spark, d), 5, 0, "row", ["label"])


@query("WITH g AS (SELECT vec_id % 29 AS grp, CAST((vec_id % 29) % 3 AS INTEGER) AS label FROM embeddings GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || grp), grp) AS r, count(*) OVER (PARTITION BY label) AS n FROM g) SELECT grp, label, CASE WHEN r <= 2 AND n > 2 THEN 'validation' ELSE 'fit' END AS role FROM r")
def inner_split(spark, d):
    g = _units(spark, d).select("grp", (F.col("grp") % 3).cast("int").alias("label")).distinct()
    return splits.inner_split(g, 2, 42)


@query("SELECT label, vec_id % 29 AS grp, count(*) AS n FROM embeddings GROUP BY 1, 2")
def group_counts(spark, d):
    return _units(spark, d).groupBy("label", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT vec_id % 29) AS n_groups FROM embeddings WHERE vec_id % 4 = 0")
def validation_group_count(spark, d):
    return _units(spark, d).where("row % 4 = 0").agg(F.count_distinct("grp").alias("n_groups"))


@query("WITH n AS (SELECT vec_id AS row, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) SELECT row FROM n WHERE i IN (SELECT DISTINCT round_even(k * (m - 1) / 19.0, 0) FROM (SELECT unnest(generate_series(0, 19)) AS k, (SELECT count(*) FROM embeddings) AS m))")
def evenly_spaced_subset(spark, d):
    return splits.evenly_spaced(_units(spark, d), 20, "row").select("row")


@query("SELECT source, round(avg(toxic), 6) AS rate FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY source ORDER BY avg(toxic), source LIMIT 6")
def hardest_k(spark, d):
    rates = views.table(spark, d, "labels").join(views.table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg("toxic").alias("rate"))
    return rounded(rates.orderBy("rate", "source").limit(6))


# -- fusion ---------------------------------------------------------------------------------------------------
OBS = "WITH RECURSIVE o AS (SELECT user_id AS rec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CASE WHEN event_id % 97 < 50 THEN 0.9 ELSE value / (value + 40) END AS p FROM events), pf AS (SELECT *, avg(p) OVER (PARTITION BY rec ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS p_fault, count(*) OVER (PARTITION BY rec ORDER BY n ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n_obs FROM o), "
FSM = OBS + """st AS (
  SELECT rec, CAST(-1 AS BIGINT) AS n, 0 AS rise, 0 AS warn, 0 AS clear, 'Normal' AS status, CAST(0 AS DOUBLE) AS p_fault FROM (SELECT DISTINCT rec FROM pf)
  UNION ALL
  SELECT rec, n, rise, warn, clear, CASE WHEN rise >= 3 AND rec % 2 = 0 THEN 'Fault' WHEN warn >= 3 THEN CASE WHEN prior = 'Fault' THEN 'Fault' ELSE 'Warning' END WHEN clear >= 3 THEN 'Normal' ELSE prior END AS status, p_fault
  FROM (SELECT p.rec, p.n, p.p_fault, s.status AS prior, CASE WHEN p.p_fault >= 0.7 THEN s.rise + 1 ELSE 0 END AS rise, CASE WHEN p.p_fault >= 0.45 THEN s.warn + 1 ELSE 0 END AS warn, CASE WHEN p.p_fault < 0.35 THEN s.clear + 1 ELSE 0 END AS clear FROM st s JOIN pf p ON p.rec = s.rec AND p.n = s.n + 1)) """


def _obs(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return views.table(spark, d, "events").select(F.col("user_id").alias("rec"), (F.row_number().over(order) - 1).cast("long").alias("n"), F.when(F.col("event_id") % 97 < 50, 0.9).otherwise(F.col("value") / (F.col("value") + 40)).alias("p"))


def _trace(spark, d):
    return fusion.trace(_obs(spark, d), F.col("rec") % 2 == 0)


@query(OBS.rstrip(", ") + " SELECT rec, n, round(p_fault, 6) AS p_fault, n_obs FROM pf")
def rolling_pfault(spark, d):
    return rounded(fusion.pooled(_obs(spark, d)).select("rec", "n", "p_fault", "n_obs"))


@query(FSM + "SELECT rec, n, round(p_fault, 6) AS p_fault, status FROM st WHERE n >= 0")
def fusion_trace(spark, d):
    return rounded(_trace(spark, d))


@query(FSM + "SELECT rec, arg_max(status, n) AS status, count(*) AS n_obs_total FROM st WHERE n >= 0 GROUP BY rec")
def fusion_status(spark, d):
    return fusion.final_status(_trace(spark, d))


@query(FSM + ", f AS (SELECT rec, arg_max(status, n) AS status FROM st WHERE n >= 0 GROUP BY rec) SELECT rec % 10 AS plant, arg_max(status, k) AS status, arg_max(rec, k) AS driver FROM (SELECT *, CASE status WHEN 'Normal' THEN 0 WHEN 'Warning' THEN 1 WHEN 'Fault' THEN 2 ELSE 3 END * 1000000 - rec AS k FROM f) GROUP BY rec % 10")
def system_status(spark, d):
    return fusion.system_status(fusion.final_status(_trace(spark, d)).withColumn("plant", F.col("rec") % 10), "rec", ["plant"])


@query(FSM + ", f AS (SELECT rec, max(CASE status WHEN 'Fault' THEN 2 WHEN 'Warning' THEN 1 ELSE 0 END) AS r FROM st WHERE n >= 0 GROUP BY rec) SELECT rec, ['Normal', 'Warning', 'Fault'][r + 1] AS peak, CASE WHEN r = 2 AND rec % 3 = 0 THEN 'correct' WHEN r = 2 THEN 'false alarm' WHEN rec % 3 = 0 THEN 'missed' ELSE 'correct' END AS verdict FROM f")
def peak_status(spark, d):
    peak = _trace(spark, d).groupBy("rec").agg(F.max(fusion.rank_of(F.col("status"))).alias("r"))
    faulty = F.col("rec") % 3 == 0
    return peak.select("rec", F.get(F.array(*[F.lit(s) for s in fusion.ORDER]), F.col("r")).alias("peak"), F.when((F.col("r") == 2) == faulty, "correct").when(faulty, "missed").otherwise("false alarm").alias("verdict"))


METRICS = "WITH m AS (SELECT 'b' || label AS branch, count(DISTINCT vec_id % 29) % 6 AS groups, CASE WHEN label % 4 = 3 THEN NULL ELSE 0.5 + label * 0.05 END AS f1 FROM embeddings GROUP BY label) "


def _metrics(spark, d):
    return _units(spark, d).groupBy("label").agg((F.count_distinct("grp") % 6).alias("groups")).select(F.concat(F.lit("b"), F.col("label")).alias("branch"), "groups", F.when(F.col("label") % 4 != 3, 0.5 + F.col("label") * 0.05).alias("f1"))


@query(METRICS + "SELECT branch, groups, round(f1, 6) AS f1, CASE WHEN f1 IS NOT NULL THEN groups >= 3 END AS groups_test, CASE WHEN f1 IS NOT NULL THEN f1 >= 0.75 END AS metric_test, CASE WHEN f1 IS NULL THEN 'NOT MEASURED' WHEN groups >= 3 AND f1 >= 0.75 THEN 'Fault-capable' ELSE 'INDICATIVE' END AS tier, coalesce(groups >= 3 AND f1 >= 0.75, false) AS fault_authority FROM m")
def authority_table(spark, d):
    return rounded(fusion.authority_table(_metrics(spark, d)))


@query(METRICS + "SELECT branch, concat_ws(' · ', 'WARNING', 'S1 ' || branch, '50%', groups || ' pooled obs', CASE WHEN f1 IS NULL THEN 'branch NOT MEASURED' ELSE 'branch macro-F1 ' || printf('%.2f', f1) END, CASE WHEN NOT coalesce(groups >= 3 AND f1 >= 0.75, false) THEN 'LOW CONFIDENCE BRANCH' END) AS line FROM m")
def evidence_line(spark, d):
    may = fusion.authority(F.col("groups"), F.col("f1"))
    return _metrics(spark, d).select("branch", fusion.evidence(F.lit("Warning"), F.lit("S1"), F.col("branch"), F.lit(0.5), F.col("groups"), F.col("f1"), may).alias("line"))


# -- quantisation -----------------------------------------------------------------------------------------------
W = "WITH w AS (SELECT vec_id AS o, unnest(generate_series(0, 63)) AS i, unnest(embedding) AS e FROM embeddings), v AS (SELECT o, i, CAST(e AS DOUBLE) AS v FROM w) "
Q = "CAST(greatest(-128, least(127, round_even(v / scale, 0))) AS INTEGER)"


def _weights(spark, d):
    return views.spectra(spark, d).select(F.col("rec").alias("o"), F.col("bin").alias("i"), F.col("x").alias("v"))


@query(W + f", s AS (SELECT *, max(abs(v)) OVER (PARTITION BY o) / 127 AS sc FROM v) SELECT o, i, round(CASE WHEN sc > 0 THEN sc ELSE 1 END, 9) AS scale, {Q.replace('scale', '(CASE WHEN sc > 0 THEN sc ELSE 1 END)')} AS q FROM s")
def quant_per_channel(spark, d):
    return rounded(quant.per_channel(_weights(spark, d)).select("o", "i", "scale", "q"), 9)


@query(W + f", s AS (SELECT max(abs(v)) / 127 AS scale FROM v) SELECT o, i, {Q} AS q FROM v, s")
def quant_per_tensor(spark, d):
    return quant.per_tensor(_weights(spark, d)).select("o", "i", "q")


@query(W + ", p AS (SELECT i, quantile_cont(abs(v), 0.999) AS p FROM v GROUP BY i) SELECT i, round(CASE WHEN p > 0 THEN p / 127 ELSE 1 END, 9) AS scale FROM p")
def activation_scale(spark, d):
    return rounded(quant.activation_scale(_weights(spark, d), by=["i"]), 9)


@query("SELECT label AS layer, count(*) AS terms, CAST(count(*) * 128 * 127 + max(vec_id) AS BIGINT) AS peak, CAST(ceil(log2(count(*) * 128 * 127 + max(vec_id) + 1)) + 1 AS INTEGER) AS bits, ceil(log2(count(*) * 128 * 127 + max(vec_id) + 1)) + 1 <= 32 AS fits FROM embeddings GROUP BY label")
def accumulator_headroom(spark, d):
    layers = views.table(spark, d, "embeddings").groupBy(F.col("label").alias("layer")).agg(F.count(F.lit(1)).alias("terms"), F.max("vec_id").alias("bias_max"))
    return quant.headroom(layers)


CENTRES = "c AS (SELECT label AS o, i, round(avg(v), 9) AS v FROM (SELECT label, unnest(generate_series(0, 63)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label, i), "


@query(W.rstrip() + f", {CENTRES} cs AS (SELECT *, max(abs(v)) OVER (PARTITION BY o) / 127 AS scale FROM c), cq AS (SELECT o, i, {Q} AS q FROM cs), s AS (SELECT *, max(abs(v)) OVER (PARTITION BY o) / 127 AS scale FROM v), q AS (SELECT o, i, {Q} AS q FROM s) SELECT x.o AS row, w.o, CAST(sum(x.q * w.q) AS BIGINT) AS acc FROM q x JOIN cq w ON x.i = w.i GROUP BY x.o, w.o")
def int8_linear(spark, d):
    """A linear layer whose weights are the classes' mean vectors, on every vector."""
    centres = views.spectra(spark, d).groupBy(F.col("label").alias("o"), F.col("bin").alias("i")).agg(F.round(F.avg("x"), 9).alias("v"))
    inputs = quant.per_channel(_weights(spark, d)).select(F.col("o").alias("row"), "i", "q")
    return quant.int8_linear(quant.per_channel(centres), inputs)


@query(W + ", a AS (SELECT o, i, v, rank() OVER (PARTITION BY o ORDER BY v DESC, i) AS f, rank() OVER (PARTITION BY o ORDER BY round(v * 100, 0) DESC, i) AS q FROM v), b AS (SELECT o, max(i) FILTER (f = 1) AS top, max(i) FILTER (q = 1) AS qtop FROM a GROUP BY o) SELECT round(avg(CASE WHEN top = qtop THEN 1.0 ELSE 0 END), 6) AS agreement, count(*) FILTER (top <> qtop) AS disagreements FROM b")
def quant_agreement(spark, d):
    a = views.table(spark, d, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    both = a.select(frames.first_largest(F.col("v")).alias("f"), frames.first_largest(F.transform("v", lambda x: F.round(x * 100, 0))).alias("q"))
    return rounded(both.agg(F.avg((F.col("f") == F.col("q")).cast("double")).alias("agreement"), F.count_if(F.col("f") != F.col("q")).alias("disagreements")))


@query("WITH v AS (SELECT vec_id AS o, unnest(generate_series(0, 63)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT o, i, round(v * 1.5 / sqrt(0.25 + 1e-5), 6) AS w, round((0.1 - 0.2) * (1.5 / sqrt(0.25 + 1e-5)) + 0.3, 6) AS b FROM v")
def batchnorm_fold(spark, d):
    lit = F.lit
    w, b = quant.fold_batchnorm(F.col("x"), lit(1.5), lit(0.3), lit(0.2), lit(0.25), lit(0.1))
    return rounded(views.spectra(spark, d).select(F.col("rec").alias("o"), F.col("bin").alias("i"), w.alias("w"), b.alias("b")))


@query("WITH v AS (SELECT vec_id % 5 AS fold, unnest(generate_series(0, 63)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) SELECT fold, i // 16 AS channel, round(avg(v), 6) AS mean, round(greatest(stddev_samp(v), 1e-6), 6) AS std FROM v GROUP BY fold, i // 16")
def channel_stats(spark, d):
    return rounded(quant.channel_stats(views.spectra(spark, d).select((F.col("rec") % 5).alias("fold"), F.expr("bin div 16").alias("channel"), F.col("x").alias("v")), ["fold", "channel"]))


@query("WITH v AS (SELECT vec_id AS rec, vec_id % 5 AS fold, unnest(generate_series(0, 63)) AS bin, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM v WHERE fold <> 0) SELECT rec, bin, round((v - m) / sd, 6) AS z FROM v, s WHERE fold = 0")
def standardise_fit_only(spark, d):
    v = views.spectra(spark, d)
    fitted = v.where("rec % 5 <> 0").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return rounded(v.where("rec % 5 = 0").join(F.broadcast(fitted)).select("rec", "bin", ((F.col("x") - F.col("m")) / F.col("sd")).alias("z")))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def class_weights(spark, d):
    return rounded(quant.class_weights(views.table(spark, d, "embeddings")))
