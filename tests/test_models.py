import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotorlens.functions import assembly, boosting, kernels, network
from rotorlens.operators import electrical, fusion, protocols, reports, rules, splits, spread
from rotorlens.plans import catalogue
from rotorlens.sources import files
from rotorlens.streaming import fusion_stream

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_without_sql_runs(spark, name):
    rows = catalogue.QUERIES[name](spark, SMALL).collect()
    assert rows or name in ("start_segments", "recording_spectra", "supply_replay", "aggregation_curve")


# -- kernels ---------------------------------------------------------------------------------------------------
def test_ridge_stays_in_its_band_and_moves_as_far_as_the_parabola_says():
    fs, t = 1000.0, np.arange(2000) / 1000
    for hz in (50.0, 51.3, 97.7):
        _, found = kernels.ridge(np.sin(2 * np.pi * hz * t), fs)
        assert np.median(found) == pytest.approx(hz, abs=0.3)
    _, low = kernels.ridge(np.sin(2 * np.pi * 5 * t), fs, low=10.0)
    assert (low >= 10.0).all()
    with pytest.raises(ValueError):
        kernels.ridge(t, fs, low=600.0, high=700.0)


def test_frequency_track_refines_flat_stretches_alone():
    fs, t = 1000.0, np.arange(4000) / 1000
    x = np.sin(2 * np.pi * 50.37 * t)
    assert kernels.phase_frequency(x, fs, 50.0) == pytest.approx(50.37, abs=0.01)
    _, fine = kernels.frequency_track(x, fs)
    assert np.abs(fine - 50.37).max() < 0.25 and (fine != kernels.ridge(x, fs)[1]).all()
    ramp = np.sin(2 * np.pi * (20 * t + 5 * t * t))
    assert (kernels.frequency_track(ramp, fs)[1] == kernels.ridge(ramp, fs)[1]).mean() > 0.8


def test_envelope_segments_find_a_start():
    fs, t = 1000.0, np.arange(5000) / 1000
    x = np.clip((t - 1) * 2, 0, 1) * np.sin(2 * np.pi * 50 * t)
    found = kernels.envelope_segments(x, fs)
    assert [s[0] for s in found][:1] == ["accel"] and found[-1][0] == "cruise" and found[-1][2] - found[-1][1] > 2.5
    assert all(b - a >= 0.2 for _, a, b, _ in found)


def test_tensor_shows_a_planted_fault_at_its_order():
    fs, order = 64000.0, electrical.bearing_orders()["bpfo"]
    t = np.arange(int(fs * 1.6)) / fs
    for rpm in (900, 1500):
        shaft = rpm / 60
        current = (1 + 0.08 * np.cos(2 * np.pi * order * shaft * t)) * np.sin(2 * np.pi * 4 * shaft * t)
        current += 0.01 * np.random.default_rng(0).normal(size=len(t))
        vibration = np.random.default_rng(1).normal(size=len(t)) * 0.01
        made, speeds = assembly.recording_tensor([current, current], vibration, fs)
        assert made.shape == (2, 5, 512) and made.dtype == np.float32
        assert speeds[0]["rpm"] == pytest.approx(rpm, rel=0.005)
        near = int(round(order * 32))
        peak = made[0, 0, 32:160].argmax() + 32  # orders 1 to 5, beside the notched ones
        assert abs(peak - near) <= 2
    assert assembly.recording_tensor([t[:10], t[:10]], t[:10], fs)[0].shape == (0, 5, 512)
    assert assembly.speed_error(25.0, np.full(3, 1500.0)) == 0 and math.isnan(assembly.speed_error(25.0, np.zeros(3)))
    assert assembly.conditioned(np.zeros(5)).tolist() == [0] * 5


def test_log_bands_partition_the_power():
    x = np.random.default_rng(2).normal(size=4000)
    f, p = np.fft.rfftfreq(4000, 1 / 4000), np.abs(np.fft.rfft((x - x.mean()) * np.hanning(4000))) ** 2
    got = assembly.log_bands(x, 4000.0, (200.0, 1600.0), 8)
    assert (got**2).sum() == pytest.approx(p[(f >= 200) & (f < 1600)].sum())


# -- network ---------------------------------------------------------------------------------------------------
def _random_net(channels=2, classes=3, stages=((4, 5, 2), (6, 3, 2)), seed=1):
    net, rng = network.built(channels, classes, stages, seed), np.random.default_rng(seed)
    for s in net.stages:
        n = len(s.b)
        s.norm = (rng.uniform(0.5, 2, n), rng.normal(size=n), rng.normal(size=n), rng.uniform(0.2, 2, n))
    return net


def test_convolution_equals_its_definition():
    rng = np.random.default_rng(0)
    x, stage = rng.normal(size=(2, 3, 11)), network.Stage(rng.normal(size=(4, 3, 5)), rng.normal(size=4), 2)
    padded = np.pad(x, ((0, 0), (0, 0), (2, 2)))
    want = [[[(padded[r, :, 2 * p : 2 * p + 5] * stage.w[o]).sum() + stage.b[o] for p in range(6)] for o in range(4)] for r in range(2)]
    assert network.convolved(x, stage) == pytest.approx(np.array(want))


def test_folding_keeps_the_function_and_counts_are_those_of_the_deployed_network():
    net, x = _random_net(), np.random.default_rng(3).normal(size=(7, 2, 40))
    assert network.forward(network.folded(net), x) == pytest.approx(network.forward(net, x))
    deployed = network.built(5, 3)
    assert network.parameters(deployed) == 27555 and network.multiplications(deployed, 512) == 1691840


def test_gradients_equal_differences():
    rng, net = np.random.default_rng(4), network.built(2, 3, ((4, 5, 2), (6, 3, 2)), 1)
    x, target, weight = rng.normal(size=(5, 2, 17)), np.eye(3)[rng.integers(0, 3, 5)], rng.uniform(1, 2, 5)
    _, found = network.gradients(net, x, target, weight)
    for v, g in zip(network.values(net), found):
        at = tuple(rng.integers(0, s) for s in v.shape)
        v[at] += 1e-5
        high = network.gradients(net, x, target, weight)[0]
        v[at] -= 2e-5
        low = network.gradients(net, x, target, weight)[0]
        v[at] += 1e-5
        assert (high - low) / 2e-5 == pytest.approx(g[at], abs=1e-6)


def test_training_and_its_integer_twin():
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, 500)
    x = rng.normal(size=(500, 1, 64))
    x[np.arange(500), 0, 10 + 15 * y] += 5
    net = network.trained(x[:400], y[:400], 3, ((16, 9, 2), (32, 7, 2), (64, 5, 2), (64, 3, 2)), epochs=10, augment={"jitter": 0})
    assert (network.forward(net, x[400:]).argmax(1) == y[400:]).mean() > 0.9
    p = network.averaged(net, x[400:], (-1, 0, 1))
    assert p.sum(1) == pytest.approx(1.0)
    layers = network.quantised(net, x[:200])
    same = network.integer_forward(layers, x[400:]).argmax(1) == network.forward(net, x[400:]).argmax(1)
    assert same.mean() >= 0.98 and all(layer.bits <= 32 for layer in layers)
    tensor = network.quantised(net, x[:200], per_channel=False)
    assert len(set(tensor[0].w_scale)) == 1


def test_augmentation_leaves_shape_and_silences_one_channel_at_most():
    rng, x = np.random.default_rng(6), np.ones((200, 3, 16))
    out = network.augmented(x, rng, prob=1.0, jitter=3, gain=0.0, dropout=1.0, noise=0.0)
    assert out.shape == x.shape and ((out.sum(2) == 0).sum(1) == 1).all()
    assert (network.augmented(x, rng, prob=0.0) == x).all()


def test_boosting_separates_classes_and_keeps_one_class():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 4))
    y = np.array(["a", "b", "c"])[(x[:, 0] > 0).astype(int) + (x[:, 1] > 0.5)]
    model = boosting.BoostedClassifier(rounds=40, rate=0.2, depth=3).fit(x[:450], y[:450])
    assert (model.predict(x[450:]) == y[450:]).mean() > 0.93
    assert model.probabilities(x).sum(1) == pytest.approx(1.0)
    assert set(boosting.BoostedClassifier(rounds=3).fit(x[:9], np.array(["a"] * 9)).predict(x)) == {"a"}
    a, b = boosting.standardised(np.array([[1.0, 5], [3, 5]]), np.array([[2.0, 6]]))
    assert a.tolist() == [[-1, 0], [1, 0]] and b.tolist() == [[0, 1]]


# -- protocols -------------------------------------------------------------------------------------------------
def _separable(spark, n=210):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        label = i % 2
        # Group 6 has one class alone.
        grp = 6 if label == 0 and i % 30 == 0 else (i // 2) % 6
        rows.append((i, [float(label * 3 + rng.normal()), float(grp)], grp, "ab"[label], i % 5, i // 5))
    return spark.createDataFrame(rows, "row long, x array<double>, grp long, label string, run long, position long")


LEARNER = protocols.boosted(rounds=10, rate=0.3, depth=2, least=5)


def test_grouped_protocol_excludes_with_a_reason(spark):
    rows = _separable(spark)
    folds, pooled = protocols.grouped(rows, "grp", "label", ["a", "b"], LEARNER, excluded=[5])
    by = {r["held_out"]: r for r in folds.collect()}
    assert by[5]["reason"] == "group excluded from scoring" and by[5]["accuracy"] is None
    assert by[6]["reason"] == "test set has one class only: a" and by[0]["reason"] is None and by[0]["accuracy"] > 0.8
    assert pooled.first()["n"] == sum(by[g]["n_test"] for g in range(5))
    found = protocols.predictions(rows.withColumn("roles", protocols.group_roles("grp", list(range(7)))), "label", LEARNER)
    assert found.groupBy("row").count().where("count > 1").isEmpty() and found.count() == 210


def test_shuffled_and_block_roles(spark):
    rows = _separable(spark)
    roles = protocols.shuffled_roles(rows, 5, 0).select("row", F.explode("roles").alias("r")).select("row", "r.*")
    assert roles.where("role = 'test'").groupBy("row").count().where("count <> 1").isEmpty() and roles.where("role = 'test'").count() == 210
    cut = protocols.block_roles(rows, 0.7, 3, ["position"], ["run"]).select("run", "position", F.col("roles")[0]["role"].alias("role"))
    last = cut.groupBy("run").agg(F.max(F.when(F.col("role") == "train", F.col("position"))).alias("a"), F.min(F.when(F.col("role") == "test", F.col("position"))).alias("b"))
    assert all(r["b"] - r["a"] == 4 for r in last.collect())
    with pytest.raises(Exception, match="one task may hold"):
        protocols.predictions(rows.withColumn("roles", protocols.group_roles("grp", [0])), "label", LEARNER, most_rows=10).collect()


class _Whole(boosting.Tree):
    """A tree whose sums are of whole numbers, so that equal gains are equal."""

    def __init__(self, places, cuts, g, h, *limits):
        super().__init__(places, cuts, np.rint(g * 2.0**spread.BITS) / 2.0**spread.BITS, np.rint(h * 2.0**spread.BITS) / 2.0**spread.BITS, *limits)


def test_trees_of_all_folds_at_once_equal_those_of_a_task_a_fold(spark, monkeypatch):
    monkeypatch.setattr(protocols, "IN_TASK", 1000)
    monkeypatch.setattr(spread, "VALUES", 400)
    monkeypatch.setattr(spread, "BATCH", 50)
    monkeypatch.setattr(boosting, "Tree", _Whole)
    rng, n = np.random.default_rng(11), 400
    x = np.stack([rng.normal(size=n), rng.integers(-1, 3, n).astype(float), np.full(n, 2.5), rng.normal(size=n) * 1e-200, rng.normal(size=n), np.full(n, np.nan)], axis=1)
    x[::9, 0] = -0.0
    x[7, 4] = np.inf  # folds that this row trains have no use for the column
    grp, label = np.arange(n) % 3, np.array(["a", "b", "c"])[(x[:, 0] > 0.2).astype(int) + (x[:, 1] > 1)]
    rows = spark.createDataFrame([(i, x[i].tolist(), int(grp[i]), str(label[i])) for i in range(n)], "row long, x array<double>, grp long, label string")
    found = protocols.predictions(rows.repartition(5).withColumn("roles", protocols.group_roles("grp", [0, 1, 2, 9])), "label", protocols.boosted(rounds=3, rate=0.3, depth=2, least=5)).collect()
    want = set()
    for k in range(3):
        train = grp != k
        own = [j for j in range(6) if np.isfinite(x[train, j]).all()]
        pred = boosting.BoostedClassifier(3, 0.3, 2, least=5).fit(x[train][:, own], label[train].astype(object)).predict(x[~train][:, own])
        want |= {(k, int(i), label[i], p) for i, p in zip(np.flatnonzero(~train), pred)}
    assert len(found) == n and {tuple(r) for r in found} == want


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate((rng.normal(size=3000), np.repeat(rng.normal(size=20), 50), [-1e300, 1e300, 0.0, -0.0]))
    assert (spread.values_of(spread.keys_of(x)) == x).all() and (np.diff(spread.keys_of(np.sort(x))) >= 0).all()
    base = spark.createDataFrame([([float(v)], "ab"[i % 2]) for i, v in enumerate(x)], "x array<double>, sig string")
    ranks = np.arange(0, len(x) // 2, 31)
    for most in (0, 10**6):
        spread.VALUES, before = most, spread.VALUES
        try:
            found = spread.order_statistics(base, {"a": 0, "b": 1}, 1, [[(np.array([0]), ranks), (np.array([0, 1]), ranks * 2)]])[0]
        finally:
            spread.VALUES = before
        assert (found[0] == np.sort(x[::2])[ranks]).all() and (found[1] == np.sort(x)[ranks * 2]).all()


def test_folds_are_kept_and_checked(spark, tmp_path):
    groups = spark.createDataFrame([(g,) for g in range(4)], "grp long")
    folds = splits.leave_one_group_out(groups)
    splits.saved_folds(folds, f"file://{tmp_path}/folds")
    assert splits.reloaded_folds(spark, f"file://{tmp_path}/folds", groups).count() == 4
    with pytest.raises(ValueError):
        splits.reloaded_folds(spark, f"file://{tmp_path}/folds", groups.where("grp < 3"))
    with pytest.raises(Exception, match="5 groups are needed"):
        splits.refused(folds, 5).collect()
    assigned = spark.createDataFrame([(0, 1, "train"), (0, 1, "test"), (1, 2, "train"), (1, 2, "test")], "fold int, grp long, role string")
    assert [tuple(r) for r in splits.leaks(assigned, declared=F.col("fold") == 1).collect()] == [(0, 1)]
    assert splits.shared_rows(assigned.withColumnRenamed("grp", "row")).count() == 2


# -- fusion ----------------------------------------------------------------------------------------------------
def test_fusion_of_vectors_equals_the_step_by_step_machine(spark):
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for rec in (0, 1):
        for epoch in (0, 1):
            state = ([], 0, 0, 0, "Normal", 0)
            p = np.clip(np.repeat(rng.random(15), 6) + rng.normal(0, 0.1, 90), 0, 1)
            for n, v in enumerate(p):
                rows.append((rec, epoch, n, [float(1 - v), float(v * 0.7), float(v * 0.3)]))
                state = fusion_stream.advance(state, float(v), rec == 0)
                want[rec, epoch, n] = state[4]
    out = fusion.evaluate(spark.createDataFrame(rows, "rec long, epoch int, n int, probs array<double>"), ["healthy", "x", "y"], F.col("rec") == 0).collect()
    assert {(r["rec"], r["epoch"], r["n"]): r["status"] for r in out} == want and {"Fault", "Warning"} <= set(want.values())
    first = next(r for r in out if (r["rec"], r["epoch"], r["n"]) == (0, 1, 0))
    assert first["n_obs"] == 1 and first["n_obs_total"] == 91
    with pytest.raises(Exception, match="expected 2 probabilities, got 3"):
        fusion.evaluate(spark.createDataFrame(rows[:1], "rec long, epoch int, n int, probs array<double>"), ["healthy", "x"], F.lit(True)).collect()


def test_fusion_stream_runs(spark, tmp_path):
    """The running stream over three batches leaves each recording where the batch form does."""
    rng = np.random.default_rng(10)
    p = np.clip(np.repeat(rng.random(12), 5) + rng.normal(0, 0.1, 60), 0, 1)
    rows = [(r, 1_700_000_000 + n, n, float(v), r == 0) for r in (0, 1) for n, v in enumerate(p)]
    schema = "rec long, s long, event_id long, p double, may boolean"
    for k in range(3):
        spark.createDataFrame([x for x in rows if x[2] // 20 == k], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(f"file://{tmp_path}/in").withColumn("ts", F.timestamp_seconds("s"))
    query = fusion_stream.fused(stream).writeStream.outputMode("update").format("memory").queryName("fused_test").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/ck").start()
    query.awaitTermination()
    got = {r["rec"]: r for r in spark.table("fused_test").orderBy("n_obs_total").collect()}
    batch = fusion.final_status(fusion.trace(spark.createDataFrame([(r, n, v) for r, _, n, v, _ in rows], "rec long, n long, p double"), F.col("rec") == 0))
    assert {r["rec"]: (r["status"], r["n_obs_total"]) for r in batch.collect()} == {r: (x["status"], x["n_obs_total"]) for r, x in got.items()}
    means = fusion_stream.windowed_means(stream, "30 seconds", "10 seconds").writeStream.outputMode("complete").format("memory").queryName("means_test").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/ck2").start()
    means.awaitTermination()
    assert spark.table("means_test").agg(F.sum("n")).first()[0] == 3 * len(rows)


# -- rules, files, reports -------------------------------------------------------------------------------------
def test_short_runs_join_their_left_neighbour_else_the_right(spark):
    def found(x):
        rows = spark.createDataFrame([(1, n, n * 0.1, float(v)) for n, v in enumerate(x)], "rec long, n long, t double, x double")
        return [(r["phase"], round(r["t0"], 1), round(r["t1"], 1)) for r in rules.segments(rows).orderBy("t0").collect()]

    assert found([50] * 20) == [("cruise", 0.0, 1.9)]
    assert found([50] * 10 + [60] + [50] * 10) == [("cruise", 0.0, 2.0)]
    assert [p for p, *_ in found([20 + 2 * k for k in range(15)] + [48] * 15 + [48 - 2 * k for k in range(15)])] == ["accel", "cruise", "decel"]
    parts = spark.createDataFrame([(1, "cruise", 0.0, 0.5)], "rec long, phase string, t0 double, t1 double")
    rows = spark.createDataFrame([(1, 0.2), (1, 0.9)], "rec long, t double")
    assert rules.gate(rows, parts).count() == 2 and rules.gate(rows, parts, enabled=True).count() == 1


def test_winding_features_are_scale_free_and_find_negative_sequence(spark):
    def made(gain, negative):
        k = np.arange(200)
        rows = []
        for name, shift in (("a", 0.0), ("b", -2 * np.pi / 3), ("c", 2 * np.pi / 3)):
            x = np.cos(2 * np.pi * 4 * k / 200 + shift) + negative * np.cos(2 * np.pi * 4 * k / 200 - shift) + 0.02 * np.cos(2 * np.pi * 12 * k / 200)
            rows += [(1, 0, name, int(i), float(gain * v)) for i, v in enumerate(x)]
        return electrical.winding_features(spark.createDataFrame(rows, "rec long, w int, channel string, k long, x double"), 200, 4).first().asDict()

    one, loud, clean = made(1.0, 0.1), made(1000.0, 0.1), made(1.0, 0.0)
    assert one["neg_seq_ratio"] == pytest.approx(0.10, abs=1e-6) and clean["neg_seq_ratio"] == pytest.approx(0, abs=1e-9)
    assert all(one[c] == pytest.approx(loud[c], rel=1e-6, abs=1e-9) for c in one)
    assert one["third_harmonic_ratio"] == pytest.approx(0.02, rel=0.2) and clean["park_eccentricity"] < one["park_eccentricity"]
    with pytest.raises(ValueError):
        electrical.winding_features(spark.range(0).selectExpr("id AS rec", "0 AS w", "'a' AS channel", "id AS k", "0D AS x"), 100, 4)


def test_raw_columns_and_telemetry(spark, tmp_path):
    rows = 100
    data = {c: np.arange(rows) * 1.5 + k for k, c in enumerate(files.RAW_COLUMNS)}
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.mat").write_bytes(b"h" * files.RAW_HEADER + b"".join(x.astype("<f8").tobytes() for x in data.values()))
    got = files.raw_columns(spark, f"file://{tmp_path}/raw", ["I2", "vib_x"], rows, stride=10).collect()
    assert {(r["channel"], r["n"]): r["x"] for r in got} == {(c, n): data[c][10 * n] for c in ("I2", "vib_x") for n in range(10)}
    with pytest.raises(KeyError):
        files.raw_columns(spark, f"file://{tmp_path}/raw", ["no"], rows)
    with pytest.raises(Exception, match="bytes expected"):
        files.raw_index(spark, f"file://{tmp_path}/raw", rows + 1).collect()
    (tmp_path / "text").mkdir()
    (tmp_path / "text" / "a.txt").write_text("10:00:00.500 -> 1 2 3 4 5 6 7 8\r\n\r\n10:00:00.600 -> 1 2 3 4 5 6 7 9\n")
    lines = files.telemetry(spark, f"file://{tmp_path}/text", {"a.txt": 2}).orderBy("n").collect()
    assert [(r["n"], round(r["t_s"], 6), r["v"][7]) for r in lines] == [(0, 0.0, 8), (1, 0.1, 9)]
    with pytest.raises(ValueError):
        files.telemetry(spark, f"file://{tmp_path}/text", {"a.txt": 3})
    assert [tuple(r) for r in files.census(spark, f"file://{tmp_path}/text", ["a.txt", "b.txt"]).orderBy("name").collect()] == [("a.txt", True), ("b.txt", False)]


def test_same_recordings(spark):
    rows = spark.createDataFrame([(r, "I1", n, float(n)) for r in "ab" for n in range(4)] + [("c", "I1", n, float(n + (n == 2))) for n in range(4)], "rec string, channel string, n long, x double")
    assert files.same_recordings(rows, "a", "b") is True and files.same_recordings(rows, "a", "c") is False and files.same_recordings(rows, "a", "z") is None


def test_memory_files_round_trip(spark, tmp_path):
    for bits, values in ((8, [-1, 0, 127, -128]), (32, [-(2**31), 2**31 - 1, 5])):
        path = f"file://{tmp_path}/m{bits}.mem"
        files.write_memory(spark.createDataFrame(list(enumerate(values)), "i long, v long"), path, bits)
        assert [r["v"] for r in files.read_memory(spark, path, bits).orderBy("i").collect()] == values


def test_cache_contract(spark, tmp_path):
    path, rows = f"file://{tmp_path}/cache", [("a", 0, [1.0], None), ("b", None, None, "too short")]
    report = files.write_cache(spark.createDataFrame(rows, "file string, window int, x array<double>, error string"), path, {"bins": 512})
    assert (report["rows"], report["files"], report["failures"]) == (1, 1, 1)
    assert files.load_cache(spark, path, {"bins": 512}).count() == 1 and files.failures(spark, path).first()["error"] == "too short"
    with pytest.raises(ValueError):
        files.load_cache(spark, path, {"bins": 256})
    with pytest.raises(FileNotFoundError):
        files.load_cache(spark, f"file://{tmp_path}/none", {"bins": 512})
    files.write_results(spark.createDataFrame([(4, 0.8, "macro_f1", "V1")], "groups long, f1 double, metric_name string, protocol string"), f"file://{tmp_path}/r")
    found = {r["branch"]: r["f1"] for r in files.branch_metrics(spark, {"winding": f"file://{tmp_path}/r", "supply": f"file://{tmp_path}/none"}).collect()}
    assert found == {"winding": 0.8, "supply": None}


def test_reports(spark):
    text = reports.text_of(catalogue.QUERIES["holdout_report"](spark, SMALL))
    assert text.startswith("\n# Results by held-out group") and "| **c0** |" in text and "## Pooling recordings" in text
    assert "shuffled **(leaky reference)**" in reports.text_of(catalogue.QUERIES["control_report"](spark, SMALL))
    a = spark.createDataFrame([("V1", 0.8, 0.8), ("V2", 0.5, 0.5)], "protocol string, accuracy double, macro_f1 double")
    rows = reports.text_of(reports.compared(a, a.where("protocol = 'V1'"), ("net", "trees"), 0.02, 0)).split("\n")
    assert rows[2:] == ["| V1 | 0.8000 | 0.8000 | no difference |", "| V2 | 0.5000 | — | NOT RUN |"]
    document = "# A\n\n### X\nold\n\n### END\nrest"
    assert reports.spliced(document, "### X", "### X\nnew\n", "### END") == "# A\n\n### X\nnew\n\n### END\nrest"
    assert reports.spliced(document, "### Y", "### Y\nnew", "### END") == "# A\n\n### X\nold\n\n### Y\nnew\n\n### END\nrest"
    with pytest.raises(ValueError):
        reports.spliced(document, "### X", "t", "### NO")
