"""Queries on samples: framing, statistics, phasors, spectra, rules and segments."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import electrical, frames, rules, spectral
from ..sources import views
from .registering import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

SIG = "sig AS (SELECT user_id AS rec, user_id % 5 AS grp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, value AS x, event_type FROM events)"
LEN = "len AS (SELECT *, count(*) OVER (PARTITION BY rec) AS len FROM sig)"
FR = "fr AS (SELECT rec, w, n - w * 5 AS k, x FROM (SELECT *, unnest(generate_series(CAST(greatest(0, ceil((n - 9) / 5.0)) AS BIGINT), n // 5)) AS w FROM len) WHERE w * 5 + 10 <= len)"
FRAMES = f"WITH {SIG}, {LEN}, {FR} "
DAY = """d0 AS (
  SELECT CAST(ts AS DATE) AS rec, CASE event_type WHEN 'click' THEN 'I1' WHEN 'view' THEN 'I2' WHEN 'purchase' THEN 'I3' WHEN 'error' THEN 'vib_x' END AS channel, ts, event_id, value
  FROM events WHERE event_type IN ('click', 'view', 'purchase', 'error')),
d1 AS (SELECT *, row_number() OVER (PARTITION BY rec, channel ORDER BY ts, event_id) - 1 AS n FROM d0),
day AS (SELECT rec, channel, n, value * CASE WHEN channel = 'I1' AND (n // 16) % 2 = 1 THEN 0.002 WHEN channel = 'vib_x' AND day(rec) % 2 = 0 THEN 1e-6 ELSE 1.0 END AS x FROM d1)"""
TRACK = """dl AS (SELECT *, count(*) OVER (PARTITION BY rec, channel) AS len FROM day),
tr AS (
  SELECT rec, channel, w, sqrt(avg(x * x)) AS rms FROM (SELECT *, unnest(generate_series(CAST(greatest(0, ceil((n - 3) / 2.0)) AS BIGINT), n // 2)) AS w FROM dl)
  WHERE w * 2 + 4 <= len GROUP BY rec, channel, w),
wd AS (
  SELECT rec, w, (w * 2 + 2) / 10.0 AS t, max(rms) FILTER (channel = 'I1') AS r1, max(rms) FILTER (channel = 'I2') AS r2, max(rms) FILTER (channel = 'I3') AS r3, max(rms) FILTER (channel = 'vib_x') AS ov
  FROM tr GROUP BY rec, w),
wv AS (SELECT * EXCLUDE (ov), last_value(ov IGNORE NULLS) OVER (PARTITION BY rec ORDER BY w) AS vib FROM wd QUALIFY r1 IS NOT NULL AND r2 IS NOT NULL AND r3 IS NOT NULL),
ls AS (
  SELECT *, coalesce(vib > 0.005, true) AS rotating, greatest(r1, r2, r3) < 0.05 AS is_off,
    list_filter([CASE WHEN r1 < 0.05 * (r2 + r3) / 2 THEN 0 END, CASE WHEN r2 < 0.05 * (r1 + r3) / 2 THEN 1 END, CASE WHEN r3 < 0.05 * (r1 + r2) / 2 THEN 2 END], lambda v: v IS NOT NULL) AS l0
  FROM wv),
v AS (SELECT *, CASE WHEN is_off THEN [] ELSE l0 END AS lost, CASE WHEN is_off THEN 'off' WHEN len(l0) = 0 THEN 'normal' WHEN rotating THEN 'phase_loss_running' ELSE 'single_phasing_start' END AS state FROM ls)"""
RUNS = """ch AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY rec ORDER BY w) = state THEN 0 ELSE 1 END AS c FROM v),
rn AS (SELECT *, sum(c) OVER (PARTITION BY rec ORDER BY w) AS run FROM ch),
ev AS (
  SELECT rec, run, state, min(w) AS w0, max(w) AS w1, min(t) AS t0, max(t) AS t1, list_sort(list_distinct(flatten(list(lost)))) AS phases
  FROM rn WHERE state IN ('phase_loss_running', 'single_phasing_start') GROUP BY rec, run, state HAVING (max(w) - min(w)) * 2 >= 5)"""
RULE = f"WITH {DAY}, {TRACK} "
EVENTS = f"WITH {DAY}, {TRACK}, {RUNS} "
WIDE = f"""WITH {DAY},
ph AS (SELECT rec, channel, 2 * sum(x * cos(n * {2 * math.pi * 0.1!r})) / count(*) AS re, -2 * sum(x * sin(n * {2 * math.pi * 0.1!r})) / count(*) AS im FROM day WHERE channel <> 'vib_x' AND n < (SELECT least(100000, min(s)) FROM (SELECT q.rec, count(*) AS s FROM day q WHERE q.channel <> 'vib_x' GROUP BY q.rec, q.channel) c WHERE c.rec = day.rec) GROUP BY rec, channel),
wide AS (
  SELECT rec, max(re) FILTER (channel = 'I1') AS ar, max(im) FILTER (channel = 'I1') AS ai, max(re) FILTER (channel = 'I2') AS br, max(im) FILTER (channel = 'I2') AS bi, max(re) FILTER (channel = 'I3') AS cr, max(im) FILTER (channel = 'I3') AS ci
  FROM ph GROUP BY rec),
sg AS (SELECT * FROM (VALUES (0, 1, 1), (1, 1, -1), (2, -1, 1), (3, -1, -1)) s(k, sb, sc)),
sq AS (
  SELECT rec, k, sb, sc, sqrt((ar + sb * br + sc * cr) ** 2 + (ai + sb * bi + sc * ci) ** 2) / 3 AS i0,
    sqrt((ar - 0.5 * sb * br - h * sb * bi - 0.5 * sc * cr + h * sc * ci) ** 2 + (ai - 0.5 * sb * bi + h * sb * br - 0.5 * sc * ci - h * sc * cr) ** 2) / 3 AS i1,
    sqrt((ar - 0.5 * sb * br + h * sb * bi - 0.5 * sc * cr - h * sc * ci) ** 2 + (ai - 0.5 * sb * bi - h * sb * br - 0.5 * sc * ci + h * sc * cr) ** 2) / 3 AS i2
  FROM wide, sg, (SELECT sqrt(3) / 2 AS h)) """
TURN = repr(2 * math.pi / 64)
SPEC = f"""WITH e AS (SELECT vec_id AS rec, embedding AS a, unnest(generate_series(0, 32)) AS bin FROM embeddings),
ex AS (SELECT rec, bin, unnest(a) AS x, unnest(generate_series(0, 63)) AS i FROM e),
mag AS (SELECT rec, CAST(bin AS INTEGER) AS bin, sqrt(sum(CAST(x AS DOUBLE) * cos(bin * i * {TURN})) ** 2 + sum(CAST(x AS DOUBLE) * sin(bin * i * {TURN})) ** 2) / 32.0 AS mag FROM ex GROUP BY rec, bin) """
GATHER = "CASE WHEN p >= 0 AND p <= 63 THEN a[CAST(floor(p) AS INTEGER) + 1] + (p - floor(p)) * (coalesce(a[CAST(floor(p) AS INTEGER) + 2], a[CAST(floor(p) AS INTEGER) + 1]) - a[CAST(floor(p) AS INTEGER) + 1]) ELSE 0.0 END"


def _framed(spark, d):
    return frames.frames(views.user_signals(spark, d), 10, 5)


def _verdicts(spark, d):
    return rules.verdicts(views.day_signals(spark, d), 4, 2, 10.0)


def _events(spark, d):
    return rules.events(_verdicts(spark, d), 2, 10.0)


def _wide(spark, d):
    # The transform's own limit; phases are cut to the shortest.
    aligned = frames.align_shortest(views.day_signals(spark, d).where("channel <> 'vib_x'"))
    return electrical.side_by_side(electrical.phasors(aligned, 0.1, limit=100_000))


def _arrays(spark, d, name="a"):
    """rec and |embedding| as an array of doubles."""
    return views.table(spark, d, "embeddings").select(F.col("vec_id").alias("rec"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias(name))


@query(f"WITH {SIG} SELECT rec, count(*) AS n_samples, CAST(CASE WHEN count(*) >= 10 THEN (count(*) - 10) // 5 + 1 ELSE 0 END AS BIGINT) AS n_frames FROM sig GROUP BY rec")
def frames_count(spark: SparkSession, d: str) -> DataFrame:
    return frames.frame_counts(views.user_signals(spark, d), 10, 5)


@query(FRAMES + "SELECT rec, w, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS low, round(max(x), 6) AS high, round(sqrt(avg(x * x)), 6) AS rms FROM fr GROUP BY rec, w")
def frame_stats(spark, d):
    return rounded(frames.frame_stats(_framed(spark, d)))


@query(FRAMES + "SELECT rec, w, round((w * 5 + 5) / 10.0, 6) AS t, round(sqrt(avg(x * x)), 6) AS rms FROM fr GROUP BY rec, w")
def rms_track(spark, d):
    return rounded(frames.rms_track(views.user_signals(spark, d), 10, 5, 10.0))


@query(FRAMES + ", c AS (SELECT rec, w, k, x AS a, x * 0.5 + k AS b, x + 500 AS t1, 500 - x AS t2, 500 + k * 2 AS t3 FROM fr), f AS (SELECT rec, w, "
       + ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max" for c in ("a", "b", "t1", "t2", "t3"))
       + ", " + ", ".join(f"(arg_max({c}, k) - arg_min({c}, k)) / 1.0 AS {c}_rate" for c in ("t1", "t2", "t3")) + " FROM c GROUP BY rec, w) SELECT rec, w, "
       + ", ".join(f"round({c}_{s}, 6) AS {c}_{s}" for c in ("a", "b", "t1", "t2", "t3") for s in ("mean", "std", "min", "max")) + ", " + ", ".join(f"round({c}_rate, 6) AS {c}_rate" for c in ("t1", "t2", "t3"))
       + ", round(CASE WHEN (abs(a_mean) + abs(b_mean)) / 2 > 1e-9 THEN (a_mean - b_mean) / ((abs(a_mean) + abs(b_mean)) / 2) ELSE 0 END, 6) AS imbalance, round(abs(a_mean - b_mean), 6) AS current_diff, round(t1_mean - t2_mean, 6) AS d12, round(t1_mean - t3_mean, 6) AS d13, round(t2_mean - t3_mean, 6) AS d23, round(greatest(t1_mean, t2_mean, t3_mean) - least(t1_mean, t2_mean, t3_mean), 6) AS spread, round(least(t1_rate, t2_rate, t3_rate), 6) AS rate_min, round(greatest(t1_rate, t2_rate, t3_rate), 6) AS rate_max FROM f")
def telemetry_features(spark, d):
    k, x = F.col("k"), F.col("x")
    f = _framed(spark, d).select("rec", "w", "k", x.alias("a"), (x * 0.5 + k).alias("b"), (x + 500).alias("t1"), (500 - x).alias("t2"), (500 + k * 2).cast("double").alias("t3"))
    return rounded(frames.telemetry_features(f, 10, 10.0))


@query(f"WITH {DAY}, z AS (SELECT rec, channel, count(*) AS c FROM day GROUP BY rec, channel), m AS (SELECT rec, min(c) AS s FROM z GROUP BY rec) SELECT day.rec, channel, count(*) AS n, round(sum(x), 6) AS total FROM day JOIN m ON day.rec = m.rec AND n < s GROUP BY day.rec, channel")
def align_shortest(spark, d):
    return rounded(frames.align_shortest(views.day_signals(spark, d)).groupBy("rec", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total")))


@query(f"WITH {DAY} SELECT rec, round(min(c) / 10.0, 6) AS duration FROM (SELECT rec, channel, count(*) AS c FROM day GROUP BY rec, channel) GROUP BY rec")
def recording_duration(spark, d):
    return rounded(frames.durations(views.day_signals(spark, d), 10.0))


@query(f"WITH {DAY} SELECT rec, '[' || string_agg(channel || '@10Hz x' || c, ', ' ORDER BY channel || '@10Hz x' || c) || ']' AS summary FROM (SELECT rec, channel, count(*) AS c FROM day GROUP BY rec, channel) GROUP BY rec")
def recording_summary(spark, d):
    return frames.summaries(views.day_signals(spark, d), 10.0)


@query("WITH r AS (SELECT user_id AS rec, 'S' || (user_id % 6) AS stage, CASE WHEN user_id % 7 = 0 THEN ' ' ELSE 'g' || (user_id % 3) END AS grp, CASE WHEN user_id % 5 = 0 THEN 0.0 ELSE 10.0 END AS fs, min(event_type) AS channel FROM events GROUP BY user_id) "
       "SELECT rec, stage, grp, fs, channel, list_filter([CASE WHEN stage NOT IN ('S1', 'S2', 'S3', 'S4', 'S5') THEN 'stage' END, CASE WHEN trim(grp) = '' THEN 'group' END, CASE WHEN NOT fs > 0 THEN 'rate' END, CASE WHEN channel NOT IN ('click', 'error') THEN 'channel' END], lambda v: v IS NOT NULL) AS broken FROM r "
       "WHERE stage NOT IN ('S1', 'S2', 'S3', 'S4', 'S5') OR trim(grp) = '' OR NOT fs > 0 OR channel NOT IN ('click', 'error')")  # fmt: skip
def validate_recordings(spark, d):
    u = F.col("user_id")
    r = views.table(spark, d, "events").groupBy("user_id").agg(F.min("event_type").alias("channel")).select(u.alias("rec"), F.concat(F.lit("S"), u % 6).alias("stage"), F.when(u % 7 == 0, " ").otherwise(F.concat(F.lit("g"), u % 3)).alias("grp"), F.when(u % 5 == 0, 0.0).otherwise(10.0).alias("fs"), "channel")
    return frames.violations(r, ("S1", "S2", "S3", "S4", "S5"), ("click", "error"))


@query(f"WITH {SIG}, {LEN} SELECT a.rec, a.n, round(CASE WHEN any_value(a.len) < 5 THEN any_value(a.x) ELSE median(b.x) END, 6) AS smooth FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS o FROM len) a JOIN sig b ON a.rec = b.rec AND b.n = greatest(0, least(a.len - 1, a.n + o)) GROUP BY a.rec, a.n")
def median_filter5(spark, d):
    return rounded(frames.median_filter(views.user_signals(spark, d)).select("rec", "n", "smooth"))


@query(RULE + "SELECT rec, w, round(t, 6) AS t, round(r1, 6) AS r1, round(r2, 6) AS r2, round(r3, 6) AS r3, round(vib, 6) AS vib, rotating, lost, state FROM v")
def phase_loss_rule(spark, d):
    return rounded(_verdicts(spark, d))


@query(EVENTS + "SELECT rec, CAST(run AS BIGINT) AS run, state, w0, w1, round(t0, 6) AS t0, round(t1, 6) AS t1, phases, round(t1 - t0, 3) AS duration_s FROM ev")
def fault_events(spark, d):
    return rounded(_events(spark, d))


@query(RULE + "SELECT rec, state, count(*) AS n FROM v GROUP BY rec, state")
def state_counts(spark, d):
    return _verdicts(spark, d).groupBy("rec", "state").agg(F.count(F.lit(1)).alias("n"))


@query(EVENTS + ", x AS (SELECT rec, max(CASE WHEN state = 'single_phasing_start' THEN 2 ELSE 1 END) AS s FROM ev GROUP BY rec) SELECT r.rec, CASE s WHEN 2 THEN 'single_phasing_start' WHEN 1 THEN 'phase_loss_running' ELSE 'normal' END AS verdict FROM (SELECT DISTINCT rec FROM v) r LEFT JOIN x ON r.rec = x.rec")
def recording_verdict(spark, d):
    return rules.recording_verdicts(_verdicts(spark, d), _events(spark, d))


@query(EVENTS + """, f AS (SELECT rec, t0, t1, coalesce(phases[1], 0) AS phase FROM ev QUALIFY row_number() OVER (PARTITION BY rec ORDER BY t0) = 1),
s AS (SELECT v.*, f.t0, f.t1, f.phase, [r1, r2, r3][f.phase + 1] AS s, state <> 'off' AS live FROM v JOIN f ON v.rec = f.rec),
l AS (SELECT rec, median(s) FILTER (live AND t < t0) AS hi, median(s) FILTER (t BETWEEN t0 AND t1) AS lo FROM s GROUP BY rec),
c AS (SELECT s.rec, phase, t0, hi, min(t) FILTER (live AND s < (hi + lo) / 2 AND t <= t1) AS cr FROM s JOIN l ON s.rec = l.rec GROUP BY s.rec, phase, t0, hi)
SELECT rec, phase, round(t0, 6) AS t_detected, round(CASE WHEN hi IS NULL THEN t0 ELSE coalesce(cr, t0) END, 6) AS t_truth, round(t0 - CASE WHEN hi IS NULL THEN t0 ELSE coalesce(cr, t0) END, 4) AS latency_s FROM c""")
def detection_latency(spark, d):
    return rounded(rules.detection_latency(_verdicts(spark, d), _events(spark, d)))


@query(f"WITH {SIG}, c AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY rec ORDER BY n) = event_type THEN 0 ELSE 1 END AS c FROM sig), r AS (SELECT *, sum(c) OVER (PARTITION BY rec ORDER BY n) AS run FROM c) SELECT rec, CAST(run AS BIGINT) AS run, event_type, min(n) AS first_n, max(n) + 1 AS end_n FROM r GROUP BY rec, run, event_type")
def run_length_encode(spark, d):
    return frames.runs(views.user_signals(spark, d), "event_type").groupBy("rec", "run", "event_type").agg(F.min("n").alias("first_n"), (F.max("n") + 1).alias("end_n"))


TRACKS = f"""WITH {SIG}, tk AS (SELECT rec, n, n * 0.25 + (n % 3) * 0.05 AS t, x FROM sig),
g AS (SELECT *, t - lag(t) OVER o AS b, lead(t) OVER o - t AS f, lag(x) OVER o AS lo, lead(x) OVER o AS hi FROM tk WINDOW o AS (PARTITION BY rec ORDER BY n)),
sl AS (SELECT rec, n, t, x, CASE WHEN b IS NULL THEN (hi - x) / f WHEN f IS NULL THEN (x - lo) / b ELSE (b * b * hi + (f * f - b * b) * x - f * f * lo) / (b * f * (b + f)) END AS slope FROM g) """


def _track(spark, d):
    return views.user_signals(spark, d).select("rec", "n", (F.col("n") * 0.25 + (F.col("n") % 3) * 0.05).alias("t"), "x")


@query(TRACKS + "SELECT rec, n, round(slope, 4) AS slope FROM sl")
def gradient(spark, d):
    return rounded(frames.gradient(_track(spark, d)).select("rec", "n", "slope"), 4)


@query(TRACKS + "SELECT rec, CASE WHEN slope > 2.01234 THEN 'accel' WHEN slope < -2.01234 THEN 'decel' ELSE 'cruise' END AS phase, count(*) AS n FROM sl GROUP BY ALL")
def segments_raw(spark, d):
    return rules.segment_flags(_track(spark, d), 2.01234).groupBy("rec", "phase").agg(F.count(F.lit(1)).alias("n"))


@query()
def segments_absorbed(spark, d):
    return rounded(rules.segments(_track(spark, d)))


@query(f"WITH {SIG}, {LEN}, c AS (SELECT rec, n * 0.25 AS t0, n * 0.25 + 1.0 AS t1 FROM sig WHERE n % 12 = 0) SELECT s.rec, s.n, bool_or(coalesce(s.n * 0.25 BETWEEN c.t0 AND c.t1, false)) AS cruise FROM sig s LEFT JOIN c ON s.rec = c.rec GROUP BY s.rec, s.n")
def cruise_mask(spark, d):
    rows = views.user_signals(spark, d).withColumn("t", F.col("n") * 0.25)
    parts = rows.where("n % 12 = 0").select("rec", F.col("t").alias("t0"), (F.col("t") + 1.0).alias("t1"), F.lit("cruise").alias("phase"))
    return rules.cruise_mask(rows, parts).select("rec", "n", "cruise")


@query(WIDE + "SELECT rec, round(i0, 6) AS i0, round(i1, 6) AS i1, round(i2, 6) AS i2 FROM sq WHERE k = 0")
def sequence_components(spark, d):
    return rounded(electrical.sequence_components(_wide(spark, d)))


@query(WIDE + "SELECT rec, round(least(i1, i2) / greatest(i1, i2), 6) AS ratio FROM sq WHERE k = 0")
def neg_seq_ratio(spark, d):
    return rounded(electrical.unbalance(electrical.sequence_components(_wide(spark, d))))


@query(WIDE + ", p AS (SELECT *, i0 / greatest(i1, i2) AS r FROM sq) SELECT a.rec, CAST(arg_min(a.sb, a.r) AS INTEGER) AS sign_b, CAST(arg_min(a.sc, a.r) AS INTEGER) AS sign_c, round(max(r) FILTER (k = 0), 6) AS before, round(min(r), 6) AS after FROM p a GROUP BY a.rec")
def polarity_argmin(spark, d):
    return rounded(electrical.polarity(_wide(spark, d)))


@query(WIDE + ", g AS (SELECT rec, br * ci - cr * bi AS det, -ar * ci + cr * ai AS nb, -br * ai + ar * bi AS nc FROM wide) SELECT rec, round(greatest(0.85, least(1.15, nb / det)), 6) AS gain_b, round(greatest(0.85, least(1.15, nc / det)), 6) AS gain_c FROM g")
def gain_solve(spark, d):
    return rounded(electrical.gains(_wide(spark, d)))


@query(f"WITH {DAY}, p AS (SELECT rec, n, max(x) FILTER (channel = 'I1') AS a, max(x) FILTER (channel = 'I2') AS b, max(x) FILTER (channel = 'I3') AS c FROM day GROUP BY rec, n), q AS (SELECT rec, sqrt(2 / 3.0) * (a - 0.5 * b - 0.5 * c) AS al, sqrt(2 / 3.0) * (sqrt(3) / 2) * (b - c) AS be FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL), m AS (SELECT rec, var_samp(al) AS p, var_samp(be) AS q, covar_samp(al, be) AS r FROM q GROUP BY rec), e AS (SELECT rec, (p + q) / 2 AS mid, sqrt(((p - q) / 2) ** 2 + r * r) AS gap FROM m) SELECT rec, round(CASE WHEN mid + gap > 0 THEN sqrt(greatest(0, 1 - (mid - gap) / (mid + gap))) ELSE 0 END, 6) AS eccentricity FROM e")
def park_eccentricity(spark, d):
    pick = lambda ch: F.max(F.when(F.col("channel") == ch, F.col("x")))
    wide = views.day_signals(spark, d).groupBy("rec", "n").agg(pick("I1").alias("a"), pick("I2").alias("b"), pick("I3").alias("c")).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
    return rounded(electrical.park_eccentricity(wide))


@query(SPEC + ", t AS (SELECT rec, max(mag) FILTER (bin = 2) AS f, max(mag) FILTER (bin = 6) AS h FROM mag GROUP BY rec) SELECT rec, round(CASE WHEN f > 0 THEN h / f ELSE 0 END, 4) AS ratio FROM t")
def third_harmonic_ratio(spark, d):
    m = _mags(spark, d).groupBy("rec").agg(F.max(F.when(F.col("bin") == 2, F.col("mag"))).alias("f"), F.max(F.when(F.col("bin") == 6, F.col("mag"))).alias("h"))
    return rounded(m.select("rec", F.when(F.col("f") > 0, F.col("h") / F.col("f")).otherwise(0.0).alias("ratio")), 4)


@query("SELECT DISTINCT user_id, round((user_id % 1023 + 0.5) / 1023 * 50 - 25, 6) AS amps, round(1 / (5.197222e-03 + -4.958087e-04 * l + 3.504369e-06 * l * l * l) - 273.15, 6) AS celsius, round((user_id % 1023 + 0.5) / 1023 * 5, 6) AS volts FROM (SELECT *, ln(10000 / (1023 / (user_id % 1023 + 0.5) - 1)) AS l FROM events)")
def adc_conversions(spark, d):
    adc = F.col("user_id") % 1023 + 0.5
    return rounded(views.table(spark, d, "events").select("user_id").distinct().select("user_id", electrical.acs712_amps(adc).alias("amps"), electrical.ntc_celsius(adc).alias("celsius"), electrical.bus_volts(adc).alias("volts")))


@query("WITH r AS (SELECT DISTINCT CAST(p_size * 30 AS DOUBLE) AS rpm FROM part) SELECT rpm, round(rpm / 60, 6) AS f_shaft_hz, 1.0 AS freq_resolution_hz, round(60 / rpm, 6) AS order_resolution, 0.03125 AS bin_width_orders, round(60 / rpm / 0.03125, 6) AS resolved_bins_per_order, round(rpm / 60, 6) AS shaft_revs_in_window FROM r")
def order_resolution(spark, d):
    rpm = views.table(spark, d, "part").select((F.col("p_size") * 30).cast("double").alias("rpm")).distinct()
    return rounded(rpm.select("rpm", *electrical.order_resolution(F.col("rpm"))))


@query("SELECT * FROM (VALUES ('ftf', 0.381786, 12), ('bsf', round(28.55 / 6.75 / 2 * (1 - (6.75 / 28.55) ** 2), 6), 64), ('bpfo', 3.054291, 98), ('bpfi', 4.945709, 158)) t(name, value, bin)")
def bearing_orders(spark, d):
    orders = electrical.bearing_orders()
    rows = spark.createDataFrame([(k, float(v)) for k, v in orders.items()], "name string, value double")
    return rows.select("name", F.round("value", 6).alias("value"), F.rint(F.col("value") / 0.03125).cast("int").alias("bin"))


def _mags(spark, d):
    rows = views.table(spark, d, "embeddings").select(F.col("vec_id").alias("rec"), "embedding")
    return spectral.magnitudes(rows, "embedding", 64)


@query(SPEC + "SELECT rec, bin, round(mag, 6) AS mag FROM mag")
def dft_magnitude(spark, d):
    return rounded(_mags(spark, d))


@query(SPEC + ", n AS (SELECT *, lag(mag) OVER o AS l, lead(mag) OVER o AS r FROM mag WINDOW o AS (PARTITION BY rec ORDER BY bin)), b AS (SELECT * FROM n WHERE bin BETWEEN 2 AND 28 QUALIFY row_number() OVER (PARTITION BY rec ORDER BY mag DESC, bin) = 1) SELECT rec, bin AS peak_bin, round(bin + coalesce(CASE WHEN abs(l - 2 * mag + r) > 1e-12 THEN greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * mag + r))) ELSE 0 END, 0), 4) AS peak FROM b")
def parabolic_peak(spark, d):
    return rounded(spectral.parabolic_peak(_mags(spark, d), 2, 28), 4)


@query(f"WITH a AS (SELECT vec_id AS rec, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS a, unnest(generate_series(1, 20)) AS k FROM embeddings), q AS (SELECT rec, CAST(k AS INTEGER) AS k, a, k * (1.5 + (rec % 7) * 0.4) AS p FROM a) SELECT rec, k, round({GATHER}, 6) AS v FROM q")
def order_interp(spark, d):
    return rounded(spectral.order_interp(_arrays(spark, d), "a", 1.5 + (F.col("rec") % 7) * 0.4, 20, 63))


@query(f"WITH z AS (SELECT vec_id AS rec, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS o FROM embeddings), m AS (SELECT rec, o[11] AS f, list_transform(o, lambda x, i: CASE WHEN (i - 1) % 10 = 0 AND i - 1 BETWEEN 10 AND 63 AND (i - 1) // 10 <= 8 THEN 0.0 ELSE x END) AS a FROM z), u AS (SELECT rec, f, a, unnest(generate_series(1, 16)) AS k FROM m), q AS (SELECT rec, f, a, CAST(k AS INTEGER) AS k, 10 + k * 1.7 AS p1, abs(10 - k * 1.7) AS p2 FROM u) SELECT rec, k, round(CASE WHEN f > 1e-12 THEN ({GATHER.replace('(p)', '(p1)').replace('p >=', 'p1 >=').replace('p <=', 'p1 <=').replace('p -', 'p1 -')} + {GATHER.replace('(p)', '(p2)').replace('p >=', 'p2 >=').replace('p <=', 'p2 <=').replace('p -', 'p2 -')}) / f ELSE 0 END, 4) AS v FROM q")
def sideband_fold(spark, d):
    return rounded(spectral.sideband_fold(_arrays(spark, d), "a", 10, F.lit(1.7), 16, 63), 4)


EDGES = [2.0 * 16.0 ** (i / 6) for i in range(7)]


@query(SPEC + ", b AS (SELECT rec, CASE " + " ".join(f"WHEN bin < {EDGES[i + 1]!r} THEN {i}" for i in range(6)) + f" END AS band, mag FROM mag WHERE bin >= {EDGES[0]!r} AND bin < {EDGES[6]!r}), p AS (SELECT rec, band, sum(mag * mag) AS p FROM b GROUP BY rec, band) SELECT r.rec, CAST(r.band AS INTEGER) AS band, round(sqrt(coalesce(p.p, 0)), 6) AS v FROM (SELECT DISTINCT rec, unnest(generate_series(0, 5)) AS band FROM mag) r LEFT JOIN p ON p.rec = r.rec AND p.band = r.band")
def log_band_energy(spark, d):
    return rounded(spectral.log_band_energy(_mags(spark, d), 2.0, 32.0, 6))


@query("WITH s AS (SELECT vec_id AS rec, unnest(embedding) AS e, unnest(generate_series(0, 63)) AS bin FROM embeddings), a AS (SELECT rec, bin, abs(CAST(e AS DOUBLE)) AS mag FROM s), m AS (SELECT rec, median(mag) AS m, avg(mag) AS g FROM a GROUP BY rec) SELECT a.rec, a.bin, round(ln(1 + mag / (CASE WHEN m > 1e-12 THEN m WHEN g > 1e-12 THEN g ELSE 1 END + 1e-12)), 6) AS v FROM a JOIN m ON a.rec = m.rec")
def condition_spectrum(spark, d):
    s = views.spectra(spark, d).select("rec", "bin", F.abs("x").alias("mag"))
    return rounded(spectral.condition(s).select("rec", "bin", "v"))


@query(SPEC + ", o AS (SELECT * FROM mag WHERE bin BETWEEN 1 AND 20), m AS (SELECT rec, greatest(median(mag), 1e-6 * max(mag)) AS s FROM o GROUP BY rec) SELECT o.rec, o.bin, round(CASE WHEN s > 0 THEN ln(1 + mag / s) ELSE 0 END, 4) AS band FROM o JOIN m ON o.rec = m.rec")
def order_bands(spark, d):
    return rounded(spectral.order_bands(_mags(spark, d).where("bin BETWEEN 1 AND 20")).select("rec", "bin", "band"), 4)


