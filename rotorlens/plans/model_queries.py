"""Queries on feature tables, models, protocols, integer twins, fusion of whole probability vectors, and reports."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import assembly, kernels, network
from ..operators import electrical, frames, fusion, metrics, protocols, quant, reports, rules, splits, spread
from ..sources import views
from . import decision_queries, signal_queries
from .registering import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

# -- feature tables -------------------------------------------------------------------------------------------
ORDERS = 10
WINDING = f"""WITH s AS (SELECT vec_id AS rec, unnest(generate_series(0, 62)) AS j, CAST(unnest(embedding[1:63]) AS DOUBLE) AS x FROM embeddings),
p AS (SELECT rec, j // 21 AS ph, j % 21 AS k, x FROM s),
h AS (SELECT rec, ph, h, sum(x * cos(k * {2 * math.pi!r} * h / 21)) AS re, -sum(x * sin(k * {2 * math.pi!r} * h / 21)) AS im FROM p, (SELECT unnest(generate_series(1, {ORDERS})) AS h) GROUP BY ALL),
b AS (SELECT rec, h, avg(sqrt(re * re + im * im)) AS band FROM h GROUP BY rec, h),
sc AS (SELECT rec, greatest(median(band), 1e-6 * max(band)) AS scale FROM b GROUP BY rec),
o AS (SELECT b.rec, {", ".join(f"max(ln(1 + band / scale)) FILTER (h = {k}) AS order_{k:02d}" for k in range(1, ORDERS + 1))} FROM b JOIN sc ON b.rec = sc.rec GROUP BY b.rec),
f AS (SELECT rec, max(re) FILTER (ph = 0) AS ar, max(im) FILTER (ph = 0) AS ai, max(re) FILTER (ph = 1) AS br, max(im) FILTER (ph = 1) AS bi, max(re) FILTER (ph = 2) AS cr, max(im) FILTER (ph = 2) AS ci FROM h WHERE h = 1 GROUP BY rec),
q AS (SELECT rec, sqrt((ar - 0.5 * br - z * bi - 0.5 * cr + z * ci) ** 2 + (ai - 0.5 * bi + z * br - 0.5 * ci - z * cr) ** 2) AS i1, sqrt((ar - 0.5 * br + z * bi - 0.5 * cr - z * ci) ** 2 + (ai - 0.5 * bi - z * br - 0.5 * ci + z * cr) ** 2) AS i2 FROM f, (SELECT sqrt(3) / 2 AS z)),
m AS (SELECT rec, ph, max(sqrt(re * re + im * im)) FILTER (h = 1) AS m1, max(sqrt(re * re + im * im)) FILTER (h = 3) AS m3 FROM h GROUP BY rec, ph),
t AS (SELECT rec, avg(CASE WHEN m1 > 0 THEN m3 / m1 ELSE 0 END) AS r3 FROM m GROUP BY rec),
w AS (SELECT rec, k, max(x) FILTER (ph = 0) AS a, max(x) FILTER (ph = 1) AS b, max(x) FILTER (ph = 2) AS c FROM p GROUP BY rec, k),
e AS (SELECT rec, var_samp(sqrt(2 / 3.0) * (a - 0.5 * b - 0.5 * c)) AS p, var_samp(sqrt(0.5) * (b - c)) AS q, covar_samp(sqrt(2 / 3.0) * (a - 0.5 * b - 0.5 * c), sqrt(0.5) * (b - c)) AS r FROM w GROUP BY rec),
g AS (SELECT rec, (p + q) / 2 AS mid, sqrt(((p - q) / 2) ** 2 + r * r) AS gap FROM e) """


@query(WINDING + "SELECT o.rec, round(least(i1, i2) / greatest(i1, i2), 5) AS neg_seq_ratio, round(sqrt(greatest(0, 1 - (mid - gap) / (mid + gap))), 5) AS park_eccentricity, round(r3, 5) AS third_harmonic_ratio, " + ", ".join(f"round(order_{k:02d}, 5) AS order_{k:02d}" for k in range(1, ORDERS + 1)) + " FROM o JOIN q ON o.rec = q.rec JOIN t ON o.rec = t.rec JOIN g ON o.rec = g.rec")
def winding_dataset(spark, d):
    s = views.spectra(spark, d).where("bin < 63")
    windows = s.select("rec", F.lit(0).alias("w"), F.element_at(F.array(*[F.lit(c) for c in "abc"]), F.expr("cast(bin div 21 as int) + 1")).alias("channel"), (F.col("bin") % 21).alias("k"), "x")
    return rounded(electrical.winding_features(windows, 21, 1, ORDERS).drop("w"), 5)


@query(signal_queries.RULE + "SELECT rec, w, state, round(r1, 6) AS r1, round(r2, 6) AS r2, round(r3, 6) AS r3, " + ", ".join(f"round(CASE WHEN m > 0 THEN r{k} / m ELSE 0 END, 6) AS q{k}" for k in (1, 2, 3)) + ", round(least(r1, r2, r3) / greatest(r1, r2, r3, 1e-9), 6) AS balance, round(coalesce(vib, 0), 6) AS vib FROM (SELECT *, r1 + r2 + r3 - greatest(r1, r2, r3) - least(r1, r2, r3) AS m FROM v) WHERE state <> 'off'")
def supply_dataset(spark, d):
    return rounded(rules.supply_features(signal_queries._verdicts(spark, d)).where("state <> 'off'"))


@query(signal_queries.EVENTS + ", c AS (SELECT rec, count(*) AS n_frames, count(*) FILTER (state = 'normal') AS n_normal, count(*) FILTER (state = 'off') AS n_off, count(*) FILTER (state = 'phase_loss_running') AS n_phase_loss_running, count(*) FILTER (state = 'single_phasing_start') AS n_single_phasing_start FROM v GROUP BY rec), x AS (SELECT rec, count(*) AS n_events, sum(round(t1 - t0, 3)) AS fault_s, max(CASE WHEN state = 'single_phasing_start' THEN 2 ELSE 1 END) AS s FROM ev GROUP BY rec) SELECT c.*, coalesce(n_events, 0) AS n_events, round(coalesce(fault_s, 0), 6) AS fault_s, CASE s WHEN 2 THEN 'single_phasing_start' WHEN 1 THEN 'phase_loss_running' ELSE 'normal' END AS verdict FROM c LEFT JOIN x ON c.rec = x.rec")
def recording_summaries(spark, d):
    return rounded(rules.recording_summaries(signal_queries._verdicts(spark, d), signal_queries._events(spark, d)))


@query(signal_queries.FRAMES + "SELECT rec, w, rec % 4 AS family, rec % 3 AS location, rec // 4 AS run, row_number() OVER (PARTITION BY rec // 4 ORDER BY rec, w) - 1 AS position, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM fr GROUP BY rec, w")
def telemetry_dataset(spark, d):
    rows = frames.frame_stats(signal_queries._framed(spark, d)).select("rec", "w", (F.col("rec") % 4).alias("family"), (F.col("rec") % 3).alias("location"), F.expr("rec div 4").alias("run"), "mean", "std")
    place = (F.row_number().over(Window.partitionBy("run").orderBy("rec", "w")) - 1).cast("long")
    return rounded(rows.withColumn("position", place))


@query("SELECT user_id AS rec, dense_rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, channel, round(CASE WHEN channel LIKE '%_adc' THEN adc ELSE (adc / 1023 * 5 - 2.5) / 0.1 END, 6) AS x FROM (SELECT *, (event_id % 1024)::DOUBLE AS adc, unnest(['Ia', 'Ia_adc']) AS channel FROM events)")
def raw_signals(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    raw = views.table(spark, d, "events").select(F.col("user_id").alias("rec"), (F.row_number().over(order) - 1).cast("long").alias("n"), F.lit("Ia").alias("channel"), (F.col("event_id") % 1024).cast("double").alias("adc"))
    return rounded(electrical.converted(raw, {"Ia": "current"}))


def _waves(spark, d):
    return views.user_signals(spark, d).groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "x"))), lambda s: s["x"]).alias("x"))


def _per_row(df, schema: str, make):
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            yield pd.DataFrame([row for rec, x in zip(b["rec"], b["x"]) for row in make(rec, np.asarray(x, float))], columns=names)

    return df.mapInPandas(run, schema)


@query()
def recording_spectra(spark, d):
    """The five-channel tensor of every window: recordings stand for two currents (one delayed) and a vibration."""

    def make(rec, x):
        made, speeds = assembly.recording_tensor([x, np.roll(x, 1)], x, 64.0, 0.5, 0.25, steps=(1, 1), bands=((2.0, 10.0), (10.0, 28.0)), search=(4.0, 30.0), bins=16, orders=8.0, raw=(4.0, 30.0))
        return [(rec, w, c, k, float(v), speeds[w]["rpm"]) for w, t in enumerate(made) for c, row in enumerate(t) for k, v in enumerate(row)]

    return rounded(_per_row(_waves(spark, d), "rec long, w long, channel long, bin long, v double, rpm double", make))


@query()
def supply_frequency_track(spark, d):
    make = lambda rec, x: [(rec, float(t), float(f)) for t, f in zip(*kernels.frequency_track(x, 64.0, 0.25, 0.0625, 4.0, 30.0))]
    return rounded(_per_row(_waves(spark, d), "rec long, t double, hz double", make))


@query()
def start_segments(spark, d):
    """Stretches of rising, steady and falling envelope."""
    make = lambda rec, x: [(rec, *s) for s in kernels.envelope_segments(x, 10.0, 0.3)] if len(x) > 8 else []
    return rounded(_per_row(_waves(spark, d), "rec long, phase string, t0 double, t1 double, slope double", make))


@query()
def shaft_speed(spark, d):
    def make(rec, x):
        if len(x) < 16:
            return []
        shaft, electrical_hz = assembly.shaft_speed(x, 64.0, 4.0, 30.0)
        return [(rec, shaft, electrical_hz, assembly.speed_error(shaft, np.full(2, 150.0)))]

    return rounded(_per_row(_waves(spark, d), "rec long, fr_hz double, f_elec_hz double, error double", make))


@query(f"WITH {signal_queries.SIG}, z AS (SELECT *, count(*) OVER (PARTITION BY rec) AS m FROM sig), h AS (SELECT rec, m, CASE WHEN n >= m // 2 THEN 1 ELSE 0 END AS h, x, n * {2 * math.pi / 64!r} * 6.0 AS a FROM z WHERE n < 2 * (m // 2)), s AS (SELECT rec, max(m) AS m, " + ", ".join(f"sum(x * {f}(a)) FILTER (h = {k}) AS {f[0]}{k}" for k in (0, 1) for f in ("cos", "sin")) + f" FROM h GROUP BY rec), p AS (SELECT rec, m, atan2(-s1, c1) - atan2(-s0, c0) AS dr FROM s) SELECT rec, round(6.0 + (dr - {2 * math.pi!r} * round(dr / {2 * math.pi!r})) / ({2 * math.pi!r} * (m // 2) / 64.0), 5) AS hz FROM p")
def mains_frequency(spark, d):
    return rounded(electrical.mains_frequency(views.user_signals(spark, d), F.lit(6.0), 64.0), 5)


# -- protocols ------------------------------------------------------------------------------------------------
def _rows(spark, d):
    """A feature table: vectors of seven groups, with a label, a binary label, a batch and a place in a run."""
    e = views.table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("row"), F.transform("embedding", lambda v: v.cast("double")).alias("x"), (F.col("vec_id") % 7).alias("grp"), F.concat(F.lit("c"), (F.col("label") % 3).cast("string")).alias("label"), F.concat(F.lit("s"), (F.expr("vec_id div 100") % 2).cast("string")).alias("session"), (F.col("vec_id") % 5).alias("run"), F.expr("vec_id div 5").alias("position"))
    return protocols.relabelled(rows, "label", "c0", "binary")


LABELS = ["c0", "c1", "c2"]
LEARNER = protocols.boosted(rounds=15, rate=0.2, depth=3, least=5)


@query()
def grouped_protocol(spark, d):
    """Leave-one-group-out by fold; group 6 trains and is not scored."""
    folds, _ = protocols.grouped(_rows(spark, d), "grp", "label", LABELS, LEARNER, excluded=[6])
    return rounded(folds)


@query()
def grouped_pooled(spark, d):
    return rounded(protocols.grouped(_rows(spark, d), "grp", "label", LABELS, LEARNER)[1])


@query()
def binary_protocol(spark, d):
    return rounded(protocols.grouped(_rows(spark, d), "grp", "binary", ["damaged", "healthy"], LEARNER)[1])


@query()
def shuffled_protocol(spark, d):
    return rounded(protocols.shuffled(_rows(spark, d), "label", LABELS, LEARNER))


@query()
def batch_control(spark, d):
    return rounded(protocols.batch_control(_rows(spark, d), "grp", {"session": ["s0", "s1"]}, LEARNER))


@query()
def block_protocol(spark, d):
    return rounded(protocols.block(_rows(spark, d), "label", LABELS, LEARNER))


def _learnt(epochs: int):
    def run(x, y, tests):
        classes, at = np.unique(y, return_inverse=True)
        net = network.trained(x[:, None, :], at, len(classes), ((8, 5, 2), (16, 3, 2)), epochs=epochs, augment={})
        return classes[network.averaged(net, tests[:, None, :], (-1, 0, 1)).argmax(1)]

    return run


@query()
def network_protocol(spark, d):
    """The network on the same folds, its probabilities averaged over three shifts."""
    return rounded(protocols.grouped(_rows(spark, d), "grp", "label", LABELS, _learnt(4))[1])


# -- the network and its integer twin -------------------------------------------------------------------------
@lru_cache(maxsize=1)
def _net():
    """Four stages with seeded weights and statistics that are not trivial, so that folding has work to do."""
    net, rng = network.built(1, 3, seed=5), np.random.default_rng(6)
    for s in net.stages:
        n = len(s.b)
        s.norm = (rng.uniform(0.5, 1.5, n), rng.normal(0, 0.1, n), rng.normal(0, 0.1, n), rng.uniform(0.5, 1.5, n))
    return net


def _vectors(spark, d):
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("rec"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))


@query()
def network_forward(spark, d):
    net = spark.sparkContext.broadcast(_net())  # 27,000 numbers
    make = lambda rec, x: [(rec, int(z.argmax()), float(z.max())) for z in network.forward(net.value, x[None, None])]
    return rounded(_per_row(_vectors(spark, d), "rec long, label long, logit double", make))


def _twin(spark, d):
    """The integer layers, calibrated on the first 128 vectors of a seeded order (a parameter of the export)."""
    picked = protocols.calibration_roles(_vectors(spark, d), "rec", 128, 128, 42)
    rows = _vectors(spark, d).join(F.broadcast(picked.where("role = 'calibration'")), "rec").orderBy("rec").collect()  # 128 vectors
    return network.quantised(_net(), np.array([r["x"] for r in rows])[:, None, :])


@query()
def integer_agreement(spark, d):
    """Every vector through the network and its integer twin: share of equal classes, largest difference of a logit."""
    net, layers = spark.sparkContext.broadcast(network.folded(_net())), spark.sparkContext.broadcast(_twin(spark, d))

    def make(rec, x):
        a, b = network.forward(net.value, x[None, None])[0], network.integer_forward(layers.value, x[None, None])[0]
        return [(rec, int(a.argmax() == b.argmax()), float(np.abs(a - b).max()), float(np.abs(a - b).mean()))]

    each = _per_row(_vectors(spark, d), "rec long, same long, worst double, mean double", make)
    return rounded(each.agg(F.count(F.lit(1)).alias("n"), F.avg("same").alias("agreement"), F.sum(1 - F.col("same")).alias("disagreements"), F.max("worst").alias("max_difference"), F.avg("mean").alias("mean_difference")))


@query()
def memory_export(spark, d):
    """layer, part, i, word: what the memory files of the integer twin hold."""
    out = None
    for layer in _twin(spark, d):
        for part, bits, values in (("w", 8, layer.w.ravel()), ("b", 32, layer.b)):
            rows = spark.createDataFrame([(layer.name, part, k, int(v)) for k, v in enumerate(values)], "layer string, part string, i long, v long").select("layer", "part", "i", quant.hex_word(F.col("v"), bits).alias("word"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query()
def integer_layers(spark, d):
    """Scales and accumulators of the integer twin's layers."""
    return rounded(spark.createDataFrame([(x.name, list(x.w.shape), x.terms, x.peak, x.bits, x.bits <= 32, x.x_scale, float(x.w_scale.max())) for x in _twin(spark, d)], "layer string, shape array<int>, terms long, peak long, bits int, fits boolean, x_scale double, w_scale_max double"), 9)


@query("SELECT * FROM (VALUES ('conv1', 5, 16, 9, 256, 184320), ('conv2', 16, 32, 7, 128, 458752), ('conv3', 32, 64, 5, 64, 655360), ('conv4', 64, 64, 3, 32, 393216)) t(layer, n_in, n_out, width, length, multiplications)")
def network_layers(spark, d):
    """The deployed shape on 5 x 512: length and multiplications of each stage."""
    rows, length = [], 512
    for k, s in enumerate(network.built(5, 3).stages, 1):
        length = (length + 2 * (s.width // 2) - s.width) // s.stride + 1
        rows.append((f"conv{k}", s.w.shape[1], s.w.shape[0], s.width, length, s.w.size * length))
    return spark.createDataFrame(rows, "layer string, n_in int, n_out int, width int, length int, multiplications int")


@query("WITH v AS (SELECT vec_id AS rec, label, unnest(generate_series(0, 63)) AS bin, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), s AS (SELECT rec, label, max(v) AS top FROM v GROUP BY rec, label), e AS (SELECT v.rec, bin, exp(v - top) AS e FROM v JOIN s ON v.rec = s.rec), p AS (SELECT rec, bin, e / sum(e) OVER (PARTITION BY rec) AS p FROM e), t AS (SELECT rec, (bin + s + 64) % 64 AS bin, p FROM p, (SELECT unnest([-1, 0, 1]) AS s)) SELECT rec, bin, round(avg(p), 9) AS p FROM t GROUP BY rec, bin")
def shifted_softmax(spark, d):
    """Softmax averaged over cyclic shifts, in arrays: no row is made for a shift."""
    a = _vectors(spark, d).withColumn("e", F.transform("x", lambda v: F.exp(v - F.array_max("x"))))
    p = a.withColumn("p", F.transform("e", lambda v: v / F.aggregate("e", F.lit(0.0), lambda s, x: s + x)))
    near = lambda i, s: F.get("p", F.pmod(i - s, F.lit(64)).cast("int"))
    mean = F.transform("p", lambda _, i: (near(i, -1) + near(i, 0) + near(i, 1)) / 3)
    return rounded(p.select("rec", F.posexplode(mean).alias("bin", "p")).withColumn("bin", F.col("bin").cast("long")), 9)


@query("WITH r AS (SELECT vec_id AS rec, md5('42:' || vec_id) AS o FROM embeddings), n AS (SELECT rec, row_number() OVER (ORDER BY o, rec) AS p FROM r) SELECT rec, CASE WHEN p <= 128 THEN 'calibration' ELSE 'verification' END AS role FROM n WHERE p <= 256")
def calibration_split(spark, d):
    return protocols.calibration_roles(_vectors(spark, d), "rec", 128, 128, 42)


# -- fusion of vectors ----------------------------------------------------------------------------------------
EPOCHS = decision_queries.OBS.replace("PARTITION BY rec ORDER BY n ROWS", "PARTITION BY rec, n // 40 ORDER BY n ROWS") + """st AS (
  SELECT rec, ep, ep * 40 - 1 AS n, 0 AS rise, 0 AS warn, 0 AS clear, 'Normal' AS status, CAST(0 AS DOUBLE) AS p_fault, CAST(0 AS BIGINT) AS n_obs FROM (SELECT DISTINCT rec, n // 40 AS ep FROM pf)
  UNION ALL
  SELECT rec, ep, n, rise, warn, clear, CASE WHEN rise >= 3 AND rec % 2 = 0 THEN 'Fault' WHEN warn >= 3 THEN CASE WHEN prior = 'Fault' THEN 'Fault' ELSE 'Warning' END WHEN clear >= 3 THEN 'Normal' ELSE prior END AS status, p_fault, n_obs
  FROM (SELECT p.rec, s.ep, p.n, p.p_fault, p.n_obs, s.status AS prior, CASE WHEN p.p_fault >= 0.7 THEN s.rise + 1 ELSE 0 END AS rise, CASE WHEN p.p_fault >= 0.45 THEN s.warn + 1 ELSE 0 END AS warn, CASE WHEN p.p_fault < 0.35 THEN s.clear + 1 ELSE 0 END AS clear FROM st s JOIN pf p ON p.rec = s.rec AND p.n // 40 = s.ep AND p.n = s.n + 1)) """


@query(EPOCHS + "SELECT rec, ep AS epoch, n, status, round(p_fault, 6) AS p_fault, CASE WHEN 1 - p_fault >= 0.625 * p_fault THEN 'healthy' ELSE 'inner' END AS top_class, round(greatest(1 - p_fault, 0.625 * p_fault), 6) AS confidence, n_obs, n + 1 AS n_obs_total, rec % 2 = 0 AS fault_authority FROM st WHERE n >= ep * 40")
def fusion_evaluate(spark, d):
    """Whole probability vectors of three classes, with a reset every 40 observations."""
    p = F.col("p")
    rows = decision_queries._obs(spark, d).select("rec", F.expr("n div 40").alias("epoch"), "n", F.array(1 - p, 0.625 * p, 0.375 * p).alias("probs"))
    return rounded(fusion.evaluate(rows, ["healthy", "inner", "outer"], F.col("rec") % 2 == 0))


@query()
def supply_replay(spark, d):
    """The rule's verdicts as a branch's observations, fused."""
    v = fusion.evaluate(rules.replayed(signal_queries._verdicts(spark, d)), ["normal", *rules.FAULTS], F.lit(True))
    return rounded(v)


STAGED = decision_queries.METRICS + ", st AS (SELECT 'S' || (label % 5 + 1) AS stage, 'b' || label AS branch FROM (SELECT DISTINCT label FROM embeddings) UNION ALL SELECT 'S9', 'none') "


def _stages(spark, d):
    own = views.table(spark, d, "embeddings").select("label").distinct().select(F.concat(F.lit("S"), F.col("label") % 5 + 1).alias("stage"), F.concat(F.lit("b"), F.col("label")).alias("branch"))
    return own.unionByName(spark.createDataFrame([("S9", "none")], "stage string, branch string"))


def _named_metrics(spark, d):
    return decision_queries._metrics(spark, d).withColumns({"metric_name": F.lit("macro_f1"), "protocol": F.lit("V1")})


@query(STAGED + "SELECT stage, st.branch, CASE WHEN f1 IS NULL THEN 'NOT MEASURED' WHEN groups >= 3 AND f1 >= 0.75 THEN 'Fault-capable' ELSE 'INDICATIVE' END AS tier, CASE WHEN stage = 'S1' THEN 'Warning' WHEN f1 IS NULL THEN 'NOT MEASURED' ELSE 'Normal' END AS status, CASE WHEN f1 IS NULL THEN 'no results' ELSE 'macro_f1 ' || printf('%.4f', f1) || ' · V1 · ' || groups || ' groups' END AS metric_line, coalesce(groups >= 3 AND f1 >= 0.75, false) AS can_fault, f1 IS NOT NULL AS measured FROM st LEFT JOIN m ON st.branch = m.branch")
def stage_rows(spark, d):
    stages = _stages(spark, d)
    return fusion.stage_rows(stages, _named_metrics(spark, d), stages.where("stage = 'S1'").select("branch", F.lit("Warning").alias("status")))


@query(decision_queries.METRICS + "SELECT branch, CASE WHEN f1 IS NULL THEN 'NOT MEASURED' WHEN groups >= 3 AND f1 >= 0.75 THEN 'Fault-capable' ELSE 'INDICATIVE' END AS tier, f1 IS NOT NULL AS measured, CASE WHEN f1 IS NOT NULL THEN printf('%.4f', f1) END AS metric, 'macro_f1' AS metric_name, 'V1' AS protocol, groups, 3 AS groups_floor, CAST(0.75 AS DOUBLE) AS metric_floor FROM m")
def metric_cards(spark, d):
    return fusion.metric_cards(_named_metrics(spark, d))


@query(decision_queries.METRICS + "SELECT branch, CASE WHEN f1 IS NULL THEN 'not measured' ELSE 'macro_f1 ' || printf('%.4f', f1) || ' · V1 · ' || groups || ' groups' END AS line FROM m")
def metric_lines(spark, d):
    return fusion.describe_metric(_named_metrics(spark, d))


# -- reports and documented analyses --------------------------------------------------------------------------
@query()
def holdout_report(spark, d):
    """The Markdown report of the grouped protocol, line by line."""
    rows = _rows(spark, d)
    held = list(range(7))
    # Folds are learnt once for all parts of the report.
    found = spread.stored(protocols.predictions(rows.withColumn("roles", protocols.group_roles("grp", held)), "label", LEARNER), "report-predictions")
    folds, pooled = protocols.grouped(rows, "grp", "label", LABELS, LEARNER, made=(held, found))
    place = lambda c: (F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col(c)) - 1).cast("int")
    coded = found.select(place("truth").alias("truth"), place("pred").alias("pred"), (F.col("row") % 50).alias("rec"), "row")
    votes = metrics.hard_vote(coded).join(coded.groupBy("rec").agg(F.mode("truth", True).alias("truth")), "rec")
    whole = pooled.join(F.broadcast(votes.agg(F.count(F.lit(1)).alias("recordings"), F.avg((F.col("vote") == F.col("truth")).cast("double")).alias("recording_acc"))))
    units = folds.select(F.col("held_out").alias("unit"), F.col("n_test").alias("n"), "accuracy", "reason")
    probs = coded.select(F.col("rec").alias("unit"), F.col("row").alias("rec"), "truth", F.array(*[(F.col("pred") == k).cast("double") for k in range(3)]).alias("p"))
    curve = metrics.aggregation_curve(probs.withColumn("truth", F.first("truth").over(Window.partitionBy("unit").orderBy("truth"))), [1, 2, 5], 5, 3)
    return reports.figures(whole, units, curve, metrics.confusion(coded, [0, 1, 2]), LABELS, "Results by held-out group")


@query()
def control_report(spark, d):
    return reports.controls(batch_control(spark, d), 0)


@query("WITH c AS (SELECT label, vec_id % 29 AS grp, count(*) AS n FROM embeddings GROUP BY 1, 2), a AS (SELECT label, count(*) AS g, sum(n) AS n FROM c GROUP BY label UNION ALL SELECT NULL, (SELECT count(DISTINCT grp) FROM c), (SELECT sum(n) FROM c)) SELECT printf('%-12s %4d groups %7d rows', coalesce(CAST(label AS VARCHAR), 'all'), g, CAST(n AS BIGINT)) AS line FROM a")
def split_description(spark, d):
    return splits.described(decision_queries._units(spark, d))


@query("WITH v AS (SELECT vec_id % 29 AS unit, (vec_id % 29) % 3 AS cls, unnest(generate_series(0, 63)) AS bin, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), u AS (SELECT unit, cls, bin, sum(v) AS s, count(*) AS n FROM v GROUP BY ALL), c AS (SELECT cls, bin, sum(s) AS s, sum(n) AS n FROM u GROUP BY cls, bin), d AS (SELECT u.unit, u.cls AS truth, c.cls, sum((u.s / u.n - CASE WHEN u.cls = c.cls THEN (c.s - u.s) / (c.n - u.n) ELSE c.s / c.n END) ** 2) AS d FROM u JOIN c ON u.bin = c.bin GROUP BY ALL) SELECT unit, truth, arg_min(cls, d) AS nearest FROM d GROUP BY unit, truth")
def nearest_centroid(spark, d):
    """Each unit against the class centres, its own class's without itself. One row a unit and bin meets one a class."""
    v = views.spectra(spark, d).select("unit", (F.col("unit") % 3).alias("cls"), "bin", "x")
    u = v.groupBy("unit", "cls", "bin").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    per = v.groupBy("bin", "cls").agg(F.sum("x").alias("cs"), F.count(F.lit(1)).alias("cn")).select("bin", F.col("cls").alias("other"), "cs", "cn")
    own = F.col("cls") == F.col("other")
    centre = F.when(own, (F.col("cs") - F.col("s")) / (F.col("cn") - F.col("n"))).otherwise(F.col("cs") / F.col("cn"))
    far = u.join(per, "bin").groupBy("unit", "cls", "other").agg(F.sum(F.pow(F.col("s") / F.col("n") - centre, 2)).alias("d"))
    return far.groupBy("unit", F.col("cls").alias("truth")).agg(F.min_by("other", F.struct("d", "other")).alias("nearest"))


DRAWS = 50


@query(f"WITH r AS (SELECT event_type AS kind, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY ALL), d AS (SELECT kind, v, k, md5(k || ':' || day) AS o, day FROM r, (SELECT unnest(generate_series(0, {DRAWS})) AS k)), s AS (SELECT kind, k, abs(v - lag(v) OVER (PARTITION BY kind, k ORDER BY CASE WHEN k = 0 THEN CAST(day AS VARCHAR) ELSE o END)) AS s FROM d), t AS (SELECT kind, k, round(sum(s), 9) AS t FROM s GROUP BY kind, k) SELECT a.kind, round(a.t, 6) AS variation, count(*) FILTER (b.t <= a.t) AS as_smooth, count(*) AS draws FROM t a JOIN t b ON a.kind = b.kind AND a.k = 0 AND b.k > 0 GROUP BY a.kind, a.t")
def ordering_test(spark, d):
    """Total variation of daily means in order of time against that of random orders."""
    daily = views.table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    drawn = daily.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(DRAWS))))
    day = F.col("day").cast("string")
    order = F.when(F.col("k") == 0, day).otherwise(F.md5(F.concat(F.col("k").cast("string"), F.lit(":"), day)))
    w = Window.partitionBy("kind", "k").orderBy(order)
    total = drawn.withColumn("s", F.abs(F.col("v") - F.lag("v").over(w))).groupBy("kind", "k").agg(F.round(F.sum("s"), 9).alias("t"))
    both = total.groupBy("kind").agg(F.max(F.when(F.col("k") == 0, F.col("t"))).alias("t0"), F.collect_list(F.when(F.col("k") > 0, F.col("t"))).alias("ts"))
    return rounded(both.select("kind", F.col("t0").alias("variation"), F.size(F.filter("ts", lambda t: t <= F.col("t0"))).cast("long").alias("as_smooth"), F.size("ts").cast("long").alias("draws")))


@query("SELECT event_type AS cluster, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT CAST(ts AS DATE)) = 1 AS nested FROM events GROUP BY event_type")
def cluster_nesting(spark, d):
    g = views.table(spark, d, "events").groupBy(F.col("event_type").alias("cluster"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.to_date("ts")).alias("days")).withColumn("nested", F.col("days") == 1)


@query("SELECT event_type AS channel, count(*) AS n, count(DISTINCT value) AS n_distinct, count(DISTINCT value) = 1 AS constant FROM events GROUP BY event_type")
def channel_census(spark, d):
    g = views.table(spark, d, "events").groupBy(F.col("event_type").alias("channel"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("n_distinct")).withColumn("constant", F.col("n_distinct") == 1)
