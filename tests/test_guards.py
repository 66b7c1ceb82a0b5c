import pytest
from pyspark.sql import functions as F

from rotorlens.operators import guards

SAMPLES = "rec long, channel string, fs double, n long, x double"


def test_channels_and_rates(spark):
    rows = [(r, c, 10.0, n, 1.0) for r in (1, 2) for c in ("I1", "I2", "t") for n in range(4 if c == "I1" else 3)]
    samples = spark.createDataFrame(rows, SAMPLES)
    assert {r["channel"] for r in guards.channels(samples, ["I1", "I2"]).collect()} == {"I1", "I2"}
    assert {r["channel"] for r in guards.channels(samples, ["I1"], ("t", "no")).collect()} == {"I1", "t"}
    with pytest.raises(Exception, match=r"channels \[v\] are missing; there are \[I1, I2, t\]"):
        guards.channels(samples, ["I1", "v"]).collect()
    assert guards.aligned(samples).groupBy("rec", "channel").count().select("count").distinct().collect()[0][0] == 3
    with pytest.raises(Exception, match="unlike rates"):
        guards.aligned(samples.unionByName(spark.createDataFrame([(1, "s", 4.0, 0, 1.0)], SAMPLES))).collect()


def test_overrides_are_checked(spark):
    rows = spark.createDataFrame([(1, "S1", "g", 10.0, "I1")], "rec long, stage string, grp string, fs double, channel string")
    assert guards.overridden(rows, ("S1", "S2"), ("I1",), stage="S2").first()["stage"] == "S2"
    with pytest.raises(Exception, match="recording 1 breaks: rate"):
        guards.overridden(rows, ("S1",), ("I1",), fs=0.0).collect()
    assert guards.ratios_only(rows, ["rms"]) is rows
    with pytest.raises(ValueError):
        guards.ratios_only(rows, ["fs"])


def test_out_of_sample(spark):
    rows = [("a", "bearing", "K1", True, ["K2"]), ("b", "supply", "K1", False, ["K1"])]
    schema = "scenario string, branch string, unit string, out_of_sample boolean, trained_on array<string>"
    assert guards.out_of_sample(spark.createDataFrame(rows, schema), "bearing").count() == 2
    for bad, why in ((("c", "bearing", "K1", None, ["K2"]), "not marked out of sample"), (("c", "bearing", "K1", True, ["K1"]), "trained on K1")):
        with pytest.raises(Exception, match=why):
            guards.out_of_sample(spark.createDataFrame([*rows, bad], schema), "bearing").collect()


def test_index_reports(spark):
    rows = spark.createDataFrame([("KA01", "outer")] * 3 + [("K001", "healthy")] * 2 + [("KA04", "outer")], "unit string, label string").withColumn("origin", guards.damage_origin(F.col("unit"), F.col("label")))
    got = {(r["kind"], r["name"]): (r["n"], r["odd"]) for r in guards.index_report(rows, 3).collect()}
    assert got[("origin", "none")] == (2, False) and got[("origin", "real")] == (1, False) and got[("unit", "KA01")] == (3, False) and got[("unit", "KA04")] == (1, True)
    assert tuple(guards.expected_count(rows, 7).first()) == (6, 7, False)


def test_pairs_and_healthy_duplicates(spark):
    schema = "rating_w int, fault_type string, severity_pct double, label string, modality string, name string, size long, digest string"
    rows = [(1000, k, s, "x", m, f"{k}{s}{m}", 5, "d" if s == 0 else k) for k in ("intercoil", "interturn") for s in (0.0, 1.5) for m in ("current", "vibration")]
    got = {(r["fault_type"], r["severity_pct"]): r for r in guards.paired_and_deduplicated(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 4 and got["interturn", 0.0]["duplicate_of"] == "intercoil0.0current" and got["intercoil", 0.0]["duplicate_of"] is None
    assert got["intercoil", 1.5]["vibration_file"] == "intercoil1.5vibration" and not got["interturn", 1.5]["is_duplicate"]
    with pytest.raises(Exception, match="two healthy rows"):
        guards.paired_and_deduplicated(spark.createDataFrame([r for r in rows if r[1] == "intercoil"], schema)).collect()
    with pytest.raises(Exception, match="differ"):
        guards.paired_and_deduplicated(spark.createDataFrame([r[:7] + ("other",) if r[1] == "interturn" else r for r in rows], schema)).collect()
