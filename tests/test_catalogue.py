import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotorlens.functions import kernels
from rotorlens.operators import electrical, frames, fusion, metrics, quant, rules
from rotorlens.plans import catalogue
from rotorlens.streaming import fusion_stream
from tests.parity import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(spark, SMALL, catalogue.QUERIES[name], catalogue.ORACLES[name]) == []


def test_stream_step_equals_batch(spark):
    rng = np.random.default_rng(4)
    p = np.clip(np.repeat(rng.random(20), 6) + rng.normal(0, 0.1, 120), 0, 1)
    rows = spark.createDataFrame([(r, n, float(v)) for r in (0, 1) for n, v in enumerate(p)], "rec long, n long, p double")
    batch = {(r["rec"], r["n"]): r["status"] for r in fusion.trace(rows, F.col("rec") == 0).collect()}
    for rec in (0, 1):
        state = ([], 0, 0, 0, "Normal", 0)
        for n, v in enumerate(p):
            state = fusion_stream.advance(state, float(v), rec == 0)
            assert state[4] == batch[rec, n]
    assert {"Fault", "Warning"} <= set(batch.values())
    assert "Fault" not in {s for (r, _), s in batch.items() if r == 1}


def test_frames_of_short_recordings(spark):
    rows = spark.createDataFrame([(1, n, 1.0) for n in range(9)] + [(2, n, 1.0) for n in range(10)], "rec long, n long, x double")
    assert {r["rec"]: r["n_frames"] for r in frames.frame_counts(rows, 10, 5).collect()} == {1: 0, 2: 1}
    assert frames.frames(rows, 10, 5).where("rec = 1").count() == 0
    with pytest.raises(ValueError):
        frames.frames(rows, 0, 5)


def test_adc_constants(spark):
    row = spark.range(1).select(electrical.acs712_amps(F.lit(532.0)).alias("a"), electrical.ntc_celsius(F.lit(515.0), electrical.NTC_SHIPPED).alias("t"), electrical.ntc_celsius(F.lit(0.0)).alias("none")).first()
    assert row["a"] == pytest.approx(1.0019550342130978) and row["t"] == pytest.approx(10.577241530953813) and row["none"] is None


def test_planted_polarity(spark):
    turn = 2 * math.pi / 3
    for signs in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
        ph = [np.exp(0j), 1.1 * np.exp(-1j * turn) * signs[0], 0.95 * np.exp(1j * turn) * signs[1]]
        row = electrical.polarity(spark.createDataFrame([(1, *[float(v) for z in ph for v in (z.real, z.imag)])], "rec long, ar double, ai double, br double, bi double, cr double, ci double")).first()
        assert (row["sign_b"], row["sign_c"]) == signs


def test_planted_phase_loss(spark):
    rows = [(1, ch, n, (0.001 if ch == "I2" and 40 <= n < 80 else 1.0) if ch != "vib_x" else 0.1) for ch in ("I1", "I2", "I3", "vib_x") for n in range(100)]
    v = rules.verdicts(spark.createDataFrame(rows, "rec long, channel string, n long, x double"), 4, 2, 10.0)
    found = rules.events(v, 2, 10.0).collect()
    assert [(e["state"], e["phases"]) for e in found] == [("phase_loss_running", [1])]


def test_unknown_status_is_worst_and_absent_class_scores_zero(spark):
    s = spark.createDataFrame([("Fault",), ("odd",), ("Normal",)], "status string").select("status", fusion.rank_of(F.col("status")).alias("r"))
    assert {r["status"]: r["r"] for r in s.collect()} == {"Fault": 2, "odd": 3, "Normal": 0}
    rows = spark.createDataFrame([(0, 0), (1, 1)], "truth int, pred int")
    assert metrics.macro_f1(rows, [0, 1, 2]).first()[0] == pytest.approx(2 / 3)


def test_memory_words(spark):
    row = spark.range(1).select(*[quant.hex_word(F.lit(v), 8).alias(f"c{i}") for i, v in enumerate((-1, 0, 127))], quant.hex_word(F.lit(-(2**31)), 32).alias("low")).first()
    assert tuple(row) == ("ff", "00", "7f", "80000000")


def test_kernels_find_planted_tones():
    t = np.arange(4000) / 4000
    assert kernels.fundamental(np.sin(2 * np.pi * 97.3 * t), 4000.0) == pytest.approx(97.3, abs=0.35)
    _, hz = kernels.ridge(np.sin(2 * np.pi * 120 * t), 4000.0)
    assert np.median(hz) == pytest.approx(120, abs=0.5)
    e = kernels.envelope((1 + 0.5 * np.cos(2 * np.pi * 10 * t)) * np.sin(2 * np.pi * 800 * t), 4000.0, 500.0, 1200.0)
    assert np.abs(np.fft.rfft(e))[1:50].argmax() + 1 == 10
    assert len(kernels.decimate(np.ones(64), 4)) == 16
