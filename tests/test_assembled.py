import numpy as np
import pytest

from rotorlens.operators import assembled
from rotorlens.sources import files


def test_cache_rows_and_report(spark, tmp_path):
    fs, t = 4000.0, np.arange(8000) / 4000
    current, vibration = np.sin(2 * np.pi * 100 * t), np.random.default_rng(0).normal(size=8000)
    rows = [("good", c, [float(v) for v in x], None) for c, x in (("i1", current), ("i2", current), ("vib", vibration), ("speed", [1500.0]))]
    rows += [("short", c, [1.0] * 10, None) for c in ("i1", "i2", "vib")] + [("lacks", "i1", [1.0], None), ("broken", None, None, "no file")]
    frame = spark.createDataFrame(rows, "file string, channel string, x array<double>, error string")
    made = assembled.tensors(frame, ("i1", "i2"), "vib", "speed", fs, steps=(1, 1), bands=((50.0, 300.0), (300.0, 1500.0)), raw=(50.0, 1500.0), bins=32)
    report = files.write_cache(made, f"file://{tmp_path}/cache", {"bins": 32})
    assert (report["rows"], report["files"], report["failures"]) == (3, 1, 3)
    kept = files.load_cache(spark, f"file://{tmp_path}/cache", {"bins": 32})
    row = kept.where("window = 0").first()
    assert len(row["x"]) == 5 * 32 and row["rpm_est"] == pytest.approx(1500, rel=1e-3) and row["speed_err"] < 1e-3
    why = {r["file"]: r["error"] for r in files.failures(spark, f"file://{tmp_path}/cache").collect()}
    assert "shorter than a window" in why["short"] and "missing channels" in why["lacks"] and "no file" in why["broken"]
    found = assembled.report(kept.selectExpr("*", "CAST(NULL AS STRING) AS error"), spark.createDataFrame([("good", "healthy")], "file string, label string")).first()
    assert (found["files"], found["windows"]) == (1, 3) and found["speed_err_p99"] < 1e-3
