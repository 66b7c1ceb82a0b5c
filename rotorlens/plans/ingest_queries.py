"""Queries on file names, text telemetry, deduplication, pairing, memory files and fingerprints."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import quant
from ..sources import parsing, views
from .registering import registrar, rounded

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

ONAME = "WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'notes.txt' ELSE printf('N%02d_M%02d_F%02d_KA%02d_%d.mat', o_orderkey % 16, o_orderkey % 8, o_orderkey % 11, o_orderkey % 33, o_orderkey % 80) END AS name FROM orders) "


def _names(spark, d):
    k = F.col("o_orderkey")
    return views.table(spark, d, "orders").select("o_orderkey", F.when(k % 11 == 0, "notes.txt").otherwise(F.format_string("N%02d_M%02d_F%02d_KA%02d_%d.mat", k % 16, k % 8, k % 11, k % 33, k % 80)).alias("name"))


@query(ONAME + "SELECT o_orderkey, regexp_extract(name, '^(N[0-9]{2}_M[0-9]{2}_F[0-9]{2})_', 1) AS condition, regexp_extract(name, '_(K[A-Z]?[0-9]+)_', 1) AS unit, CAST(regexp_extract(name, '_([0-9]+)[.]mat$', 1) AS INTEGER) AS run FROM n WHERE name LIKE '%.mat'")
def parse_bearing_name(spark, d):
    return parsing.bearing_names(_names(spark, d)).select("o_orderkey", "condition", "unit", "run")


@query(ONAME + "SELECT unit, count(*) AS n, count(*) <> 80 AS odd FROM (SELECT regexp_extract(name, '_(K[A-Z]?[0-9]+)_', 1) AS unit FROM n WHERE name LIKE '%.mat') WHERE unit NOT IN ('KA23', 'KA24', 'KA27') GROUP BY unit")
def index_report(spark, d):
    excluded = spark.createDataFrame([("KA23",), ("KA24",), ("KA27",)], "unit string")
    kept = parsing.bearing_names(_names(spark, d)).join(F.broadcast(excluded), "unit", "left_anti")
    return kept.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).withColumn("odd", F.col("n") != 80)


WNAME = "WITH n AS (SELECT p_partkey, (CASE p_size % 3 WHEN 0 THEN 1000 WHEN 1 THEN 1500 ELSE 3000 END) || 'W_' || (p_size % 20) || (CASE WHEN p_partkey % 2 = 0 THEN '_' ELSE '.' END) || printf('%02d', p_partkey % 100) || '_' || (CASE WHEN p_partkey % 2 = 0 THEN 'current' ELSE 'vibration' END) || '_' || (CASE p_partkey % 3 WHEN 0 THEN 'intercoil' WHEN 1 THEN 'interturn' ELSE 'coil' END) || '.tdms' AS name FROM part) "


def _windings(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    rating = F.when(s % 3 == 0, 1000).when(s % 3 == 1, 1500).otherwise(3000)
    kind = F.when(p % 3 == 0, "intercoil").when(p % 3 == 1, "interturn").otherwise("coil")
    return views.table(spark, d, "part").select("p_partkey", F.concat(rating, F.lit("W_"), s % 20, F.when(p % 2 == 0, "_").otherwise("."), F.format_string("%02d", p % 100), F.lit("_"), F.when(p % 2 == 0, "current").otherwise("vibration"), F.lit("_"), kind, F.lit(".tdms")).alias("name"))


PARSED = WNAME + ", q AS (SELECT p_partkey, CAST(regexp_extract(name, '^([0-9]+)W_', 1) AS INTEGER) AS rating_w, CAST(replace(regexp_extract(name, '^[0-9]+W_([0-9]+[._][0-9]+)_', 1), '_', '.') AS DOUBLE) AS severity_pct, regexp_extract(name, '_(current|vibration)_', 1) AS modality, CASE WHEN name LIKE '%_coil.tdms' THEN 'intercoil' ELSE regexp_extract(name, '_([a-z]+)[.]tdms$', 1) END AS fault_type FROM n) "


@query(PARSED + "SELECT *, CASE WHEN severity_pct = 0 THEN 'healthy' WHEN fault_type = 'intercoil' THEN 'inter_coil' ELSE 'inter_turn' END AS label FROM q")
def parse_winding_name(spark, d):
    return parsing.winding_names(_windings(spark, d)).select("p_partkey", "rating_w", "severity_pct", "modality", "fault_type", "label")


@query(PARSED + "SELECT rating_w, severity_pct, fault_type, min(p_partkey) FILTER (modality = 'current') AS current_key, min(p_partkey) FILTER (modality = 'vibration') AS vibration_key FROM q GROUP BY ALL")
def pair_modalities(spark, d):
    return parsing.pair_modalities(parsing.winding_names(_windings(spark, d)), "p_partkey")


@query(PARSED + "SELECT rating_w, fault_type, count(*) AS n, list_sort(list(DISTINCT severity_pct)) AS severities FROM q GROUP BY ALL")
def grid_report(spark, d):
    return parsing.winding_names(_windings(spark, d)).groupBy("rating_w", "fault_type").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("severity_pct")).alias("severities"))


@query("WITH x AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, strlen(coalesce(text, '')) AS size FROM documents), r AS (SELECT *, first_value(doc_id) OVER w AS f, row_number() OVER w AS r FROM x WINDOW w AS (PARTITION BY digest, size ORDER BY doc_id)) SELECT doc_id, r > 1 AS is_duplicate, CASE WHEN r > 1 THEN f END AS duplicate_of FROM r")
def dedup_by_digest(spark, d):
    return parsing.duplicates(views.table(spark, d, "documents"), "doc_id", "text")


CLOCK = "WITH l AS (SELECT event_id, user_id, printf('%02d:%02d:%02d.%03d', hour(ts), minute(ts), second(ts), event_id % 1000) || ' -> ' || concat_ws(' ', event_id % 1024, event_id % 7, event_id % 11, event_id % 13, event_id % 17, event_id % 19, event_id % 23, event_id % 29) AS line FROM events) "


@query(CLOCK + "SELECT event_id, round(CAST(line[1:2] AS INTEGER) * 3600 + CAST(line[4:5] AS INTEGER) * 60 + CAST(line[7:12] AS DOUBLE), 6) AS t_s, list_transform(string_split(line[17:], ' '), lambda v: CAST(v AS SMALLINT)) AS v FROM l")
def parse_clock_line(spark, d):
    k = F.col("event_id")
    lines = views.table(spark, d, "events").select("event_id", F.concat(F.format_string("%02d:%02d:%02d.%03d", F.hour("ts"), F.minute("ts"), F.second("ts"), k % 1000), F.lit(" -> "), F.concat_ws(" ", *[k % m for m in (1024, 7, 11, 13, 17, 19, 23, 29)])).alias("line"))
    return rounded(parsing.clock_lines(lines).select("event_id", "t_s", "v"))


@query("WITH o AS (SELECT user_id, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), g AS (SELECT user_id, (u - p) / 1e6 AS g FROM o WHERE p IS NOT NULL) SELECT user_id, round(median(g), 3) AS median_s, round(min(g), 3) AS min_s, round(max(g), 3) AS max_s FROM g GROUP BY user_id")
def sample_intervals(spark, d):
    return rounded(parsing.intervals(views.table(spark, d, "events"), "user_id"), 3)


@query("SELECT DISTINCT p_name AS name, CASE WHEN p_name IS NULL OR p_name = '' THEN 'unknown' WHEN starts_with(p_name, 'Current_') OR starts_with(p_name, 'Normal_') OR starts_with(p_name, 'Vibration_') THEN 'Current_<R>' WHEN regexp_matches(p_name, '^[0-9]+([.][0-9]+)?kW_') THEN 'kW_<R>ohm_current' WHEN regexp_matches(p_name, '^[0-9]+([.][0-9]+)?kw_') THEN 'kw_<R>ohm_current_<type>' ELSE 'other' END AS style FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'Current_' || p_size WHEN 1 THEN '1.5kW_' || p_size WHEN 2 THEN '3kw_' || p_size WHEN 3 THEN '' ELSE p_name END AS p_name FROM part)")
def daq_style(spark, d):
    p, s = F.col("p_partkey"), F.col("p_size")
    name = F.when(p % 5 == 0, F.concat(F.lit("Current_"), s)).when(p % 5 == 1, F.concat(F.lit("1.5kW_"), s)).when(p % 5 == 2, F.concat(F.lit("3kw_"), s)).when(p % 5 == 3, "").otherwise(F.col("p_name"))
    return views.table(spark, d, "part").select(name.alias("name")).distinct().select("name", parsing.daq_style(F.col("name")).alias("style"))


@query("SELECT vec_id, lower(lpad(to_hex(((vec_id * 37) % 256 - 128) & 255), 2, '0')) AS word8, lower(lpad(to_hex((vec_id * 7919 - 100000) & 4294967295), 8, '0')) AS word32, (vec_id * 37) % 256 - 128 AS back8, vec_id * 7919 - 100000 AS back32 FROM embeddings")
def memory_words(spark, d):
    v = views.table(spark, d, "embeddings").select("vec_id", ((F.col("vec_id") * 37) % 256 - 128).alias("a"), (F.col("vec_id") * 7919 - 100000).alias("b"))
    words = v.select("vec_id", quant.hex_word(F.col("a"), 8).alias("word8"), quant.hex_word(F.col("b"), 32).alias("word32"))
    return words.select("*", quant.from_hex_word(F.col("word8"), 8).alias("back8"), quant.from_hex_word(F.col("word32"), 32).alias("back32"))


SETTINGS = {"feature_set": "v2", "hop_s": 0.5, "n_bins": 512, "order_max": 16.0, "window_s": 1.0}


@query(f"SELECT substr(sha256('{json.dumps(SETTINGS, sort_keys=True)}'), 1, 16) AS fingerprint")
def contract_fingerprint(spark, d):
    return spark.range(1).select(parsing.fingerprint(SETTINGS).alias("fingerprint"))


@query("SELECT user_id, list_sort(list(DISTINCT event_type)) AS channels, len(list_filter(['click', 'view', 'purchase'], lambda c: NOT list_contains(list(DISTINCT event_type), c))) = 0 AS complete FROM events GROUP BY user_id")
def required_channels(spark, d):
    seen = views.table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("channels"))
    return seen.withColumn("complete", F.size(F.array_except(F.array(*[F.lit(c) for c in ("click", "view", "purchase")]), "channels")) == 0)


@query("WITH a AS (SELECT bin, label, avg(v) AS m FROM (SELECT label, unnest(generate_series(0, 63)) AS bin, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY bin, label) SELECT bin, label, round(m, 6) AS mean, n FROM a JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)")
def class_channel_means(spark, d):
    s = views.spectra(spark, d)
    return rounded(s.groupBy("bin", "label").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n")))


@query("WITH r AS (SELECT user_id % 5 AS motor, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) SELECT a.motor AS a, b.motor AS b, a.lo <= b.hi AND b.lo <= a.hi AS overlap FROM r a JOIN r b ON a.motor < b.motor")
def range_overlap(spark, d):
    r = views.table(spark, d, "events").groupBy((F.col("user_id") % 5).alias("motor")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    a, b = r.alias("a"), F.broadcast(r.alias("b"))  # one row a motor
    return a.join(b, F.col("a.motor") < F.col("b.motor")).select(F.col("a.motor").alias("a"), F.col("b.motor").alias("b"), ((F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi"))).alias("overlap"))


@query("SELECT user_id, round(sum(abs(value - p)), 4) AS variation FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id")
def total_variation(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = views.table(spark, d, "events").select("user_id", F.abs(F.col("value") - F.lag("value").over(w)).alias("step"))
    return rounded(rows.groupBy("user_id").agg(F.sum("step").alias("variation")), 4)
