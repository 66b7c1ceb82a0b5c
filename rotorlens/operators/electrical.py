"""Unit conversions, phasors and symmetrical components as column algebra; complex numbers are (re, im) pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Converter and thermistor constants.
ADC_MAX, VREF, SERIES_OHM = 1023, 5.0, 10_000.0
NTC_SHIPPED = (1.2666e-3, 2.3661e-4, 9.6094e-8)
NTC_REFITTED = (5.197222e-03, -4.958087e-04, 3.504369e-06)


def acs712_amps(adc: Column) -> Column:
    return (adc / ADC_MAX * VREF - VREF / 2) / 0.1


def ntc_celsius(adc: Column, coefficients: tuple[float, float, float] = NTC_REFITTED) -> Column:
    """Steinhart-Hart; null outside (0, 1023), where no resistance exists."""
    a, b, c = coefficients
    ln = F.ln(SERIES_OHM / (ADC_MAX / adc - 1))
    return F.when((adc > 0) & (adc < ADC_MAX), 1 / (a + b * ln + c * ln * ln * ln) - 273.15)


def bus_volts(adc: Column, ratio: float = 1.0) -> Column:
    return adc / ADC_MAX * VREF * ratio


def phasors(df: DataFrame, cycles: float, keys: tuple[str, ...] = ("rec", "channel"), limit: int | None = None) -> DataFrame:
    """Single-bin transform 2/n * sum(x * exp(-j*2*pi*cycles*n)); cycles per sample."""
    used = df if limit is None else df.where(F.col("n") < limit)
    angle = F.col("n") * (2 * math.pi * cycles)
    return used.groupBy(*keys).agg((2 * F.sum(F.col("x") * F.cos(angle)) / F.count(F.lit(1))).alias("re"), (-2 * F.sum(F.col("x") * F.sin(angle)) / F.count(F.lit(1))).alias("im"))


def side_by_side(ph: DataFrame, channels: tuple[str, str, str] = ("I1", "I2", "I3")) -> DataFrame:
    """One row per recording with re and im of three phases: ar, ai, br, bi, cr, ci."""
    pick = lambda ch, part: F.max(F.when(F.col("channel") == ch, F.col(part)))
    return ph.groupBy("rec").agg(*[pick(ch, part).alias(name + part[0]) for name, ch in zip("abc", channels) for part in ("re", "im")])


def components(sign: tuple[Column, Column, Column] | None = None) -> tuple[Column, Column, Column]:
    """Magnitudes of zero, positive and negative sequence of the columns ar..ci."""
    s = sign or (F.lit(1.0),) * 3
    (ar, ai), (br, bi), (cr, ci) = [(F.col(p + "r") * k, F.col(p + "i") * k) for p, k in zip("abc", s)]
    h, q = -0.5, math.sqrt(3) / 2
    size = lambda re, im: F.sqrt(re * re + im * im) / 3
    zero = size(ar + br + cr, ai + bi + ci)
    # a = exp(j*120 deg): a*b turns b forward, a*a*c turns c backward.
    positive = size(ar + (h * br - q * bi) + (h * cr + q * ci), ai + (h * bi + q * br) + (h * ci - q * cr))
    negative = size(ar + (h * br + q * bi) + (h * cr - q * ci), ai + (h * bi - q * br) + (h * ci + q * cr))
    return zero, positive, negative


def sequence_components(wide: DataFrame) -> DataFrame:
    zero, positive, negative = components()
    return wide.select("rec", zero.alias("i0"), positive.alias("i1"), negative.alias("i2"))


def unbalance(sequences: DataFrame) -> DataFrame:
    """Smaller over larger of positive and negative sequence; NaN if both are 0."""
    high = F.greatest("i1", "i2")
    return sequences.select("rec", F.when(high > 0, F.least("i1", "i2") / high).otherwise(F.lit(float("nan"))).alias("ratio"))


def polarity(wide: DataFrame) -> DataFrame:
    """Signs of phases b and c that make the relative zero sequence least; the first in order on ties."""
    signs = [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    relative = []
    for b, c in signs:
        zero, positive, negative = components((F.lit(1.0), F.lit(float(b)), F.lit(float(c))))
        high = F.greatest(positive, negative)
        relative.append(F.when(high > 0, zero / high).otherwise(F.lit(float("inf"))))
    all_four = wide.select("rec", F.array(*relative).alias("r"))
    best = F.array_position("r", F.array_min("r")).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in signs]), best)
    return all_four.select("rec", pick(0).alias("sign_b"), pick(1).alias("sign_c"), F.get("r", F.lit(0)).alias("before"), F.array_min("r").alias("after"))


def gains(wide: DataFrame, trim: float = 0.15) -> DataFrame:
    """Gains of b and c that cancel the zero sequence (2x2 solve), clamped to 1 -+ trim; NaN if singular."""
    det = F.col("br") * F.col("ci") - F.col("cr") * F.col("bi")
    clamp = lambda g: F.greatest(F.lit(1 - trim), F.least(F.lit(1 + trim), g))
    solve = lambda top: F.when(F.abs(det) > 1e-12, clamp(top / det)).otherwise(F.lit(float("nan")))
    b = solve(-F.col("ar") * F.col("ci") + F.col("cr") * F.col("ai"))
    c = solve(-F.col("br") * F.col("ai") + F.col("ar") * F.col("bi"))
    return wide.select("rec", b.alias("gain_b"), c.alias("gain_c"))


def park_eccentricity(df: DataFrame) -> DataFrame:
    """Eccentricity of the Park ellipse of aligned phases a, b, c: sqrt(1 - smallest / largest eigenvalue)."""
    alpha = math.sqrt(2 / 3) * (F.col("a") - 0.5 * F.col("b") - 0.5 * F.col("c"))
    beta = math.sqrt(2 / 3) * (math.sqrt(3) / 2) * (F.col("b") - F.col("c"))
    m = df.withColumn("alpha", alpha).withColumn("beta", beta).groupBy("rec").agg(F.var_samp("alpha").alias("p"), F.var_samp("beta").alias("q"), F.covar_samp("alpha", "beta").alias("r"))
    mid, gap = (F.col("p") + F.col("q")) / 2, F.sqrt(F.pow((F.col("p") - F.col("q")) / 2, 2) + F.col("r") * F.col("r"))
    return m.select("rec", F.when(mid + gap > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - (mid - gap) / (mid + gap)))).otherwise(0.0).alias("eccentricity"))


def order_resolution(rpm: Column, window_s: float = 1.0, order_max: float = 16.0, n_bins: int = 512) -> list[Column]:
    """What a window resolves at a shaft speed: Hz, orders, bins per order and turns."""
    shaft = rpm / 60
    step = F.when(shaft > 0, (1 / window_s) / shaft).otherwise(F.lit(float("inf")))
    return [shaft.alias("f_shaft_hz"), F.lit(1 / window_s).alias("freq_resolution_hz"), step.alias("order_resolution"), F.lit(order_max / n_bins).alias("bin_width_orders"), (step / (order_max / n_bins)).alias("resolved_bins_per_order"), (shaft * window_s).alias("shaft_revs_in_window")]


def bearing_orders(balls: int = 8, ball_mm: float = 6.75, pitch_mm: float = 28.55, angle_deg: float = 0.0) -> dict[str, float]:
    """Cage, ball, outer-race and inner-race orders from geometry."""
    ratio = ball_mm / pitch_mm * math.cos(math.radians(angle_deg))
    return {"ftf": (1 - ratio) / 2, "bsf": pitch_mm / ball_mm / 2 * (1 - ratio * ratio), "bpfo": balls / 2 * (1 - ratio), "bpfi": balls / 2 * (1 + ratio)}


def converted(raw: DataFrame, kinds: dict[str, str], coefficients: tuple[float, float, float] = NTC_REFITTED, ratio: float = 1.0) -> DataFrame:
    """rec, n, channel, x of raw (rec, n, channel, adc) in units, and each channel's counts again as <channel>_adc.

    kinds: current, temperature or voltage for each channel.
    """
    of = lambda kind: F.col("channel").isin([c for c, k in kinds.items() if k == kind])
    value = F.when(of("current"), acs712_amps(F.col("adc"))).when(of("temperature"), ntc_celsius(F.col("adc"), coefficients)).when(of("voltage"), bus_volts(F.col("adc"), ratio))
    both = F.array(F.struct(F.col("channel").alias("channel"), value.alias("x")), F.struct(F.concat("channel", F.lit("_adc")).alias("channel"), F.col("adc").cast("double").alias("x")))
    return raw.where(F.col("channel").isin(list(kinds))).select("rec", "n", F.explode(both).alias("s")).select("rec", "n", "s.channel", "s.x")


#: Fixed value: harmonics of the supply that a winding's features hold.
WINDING_ORDERS = 20


def winding_features(windows: DataFrame, width: int, cycles: int, orders: int = WINDING_ORDERS, keys: tuple[str, ...] = ("rec", "w")) -> DataFrame:
    """keys, neg_seq_ratio, park_eccentricity, third_harmonic_ratio, order_01.. of windows (keys, channel a/b/c, k, x).

    cycles: turns of the supply in a window of `width` samples, so that each order is a bin. One pass sums what all
    features need: phases side by side, then sines and cosines, means, squares and products.
    """
    if orders * cycles * 2 >= width:
        raise ValueError(f"order {orders} is not below half the sampling rate")
    pick = lambda ch: F.max(F.when(F.col("channel") == ch, F.col("x")))
    wide = windows.groupBy(*keys, "k").agg(*[pick(ch).alias(ch) for ch in "abc"]).where("a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL")
    alpha = math.sqrt(2 / 3) * (F.col("a") - 0.5 * F.col("b") - 0.5 * F.col("c"))
    beta = math.sqrt(0.5) * (F.col("b") - F.col("c"))
    turn = lambda h: F.col("k") * (2 * math.pi * h * cycles / width)
    # A whole number of turns sums to zero, so the mean of a window needs no taking off.
    waves = [f(F.col(ch) * g(turn(h))).alias(f"{ch}{part}{h}") for h in range(1, orders + 1) for ch in "abc" for part, f, g in (("r", F.sum, F.cos), ("i", lambda v: -F.sum(v), F.sin))]
    one = wide.withColumns({"alpha": alpha, "beta": beta}).groupBy(*keys).agg(*waves, F.count(F.lit(1)).alias("size"), F.var_samp("alpha").alias("p"), F.var_samp("beta").alias("q"), F.covar_samp("alpha", "beta").alias("r"))
    one = one.where(F.col("size") == width)
    mags = one.withColumns({f"{ch}m{h}": F.sqrt(F.col(f"{ch}r{h}") ** 2 + F.col(f"{ch}i{h}") ** 2) for h in range(1, orders + 1) for ch in "abc"})
    bands = mags.withColumn("bands", F.array(*[(F.col(f"am{h}") + F.col(f"bm{h}") + F.col(f"cm{h}")) / 3 for h in range(1, orders + 1)]))
    named = bands.withColumnsRenamed({f"{ch}{part}1": f"{ch}{part}" for ch in "abc" for part in "ri"})
    zero, positive, negative = components()
    high = F.greatest(positive, negative)
    mid, gap = (F.col("p") + F.col("q")) / 2, F.sqrt(F.pow((F.col("p") - F.col("q")) / 2, 2) + F.col("r") * F.col("r"))
    third = sum((F.when(F.col(f"{ch}m1") > 0, F.col(f"{ch}m3") / F.col(f"{ch}m1")).otherwise(0.0) for ch in "abc"), F.lit(0.0)) / 3
    ranked = F.array_sort("bands")
    middle = (F.get(ranked, F.lit((orders - 1) // 2)) + F.get(ranked, F.lit(orders // 2))) / 2
    scale = F.greatest(middle, 1e-6 * F.array_max("bands"))
    return named.select(
        *keys,
        F.when(high > 0, F.least(positive, negative) / high).otherwise(0.0).alias("neg_seq_ratio"),
        F.when(mid + gap > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - (mid - gap) / (mid + gap)))).otherwise(0.0).alias("park_eccentricity"),
        third.alias("third_harmonic_ratio"),
        *[F.when(scale > 0, F.log1p(F.get("bands", F.lit(h - 1)) / scale)).otherwise(0.0).alias(f"order_{h:02d}") for h in range(1, orders + 1)],
    )


def mains_frequency(df: DataFrame, nominal: Column, fs: float) -> DataFrame:
    """rec, hz: nominal plus the drift of its phase between the halves of a recording (rec, n, x)."""
    size = F.count(F.lit(1)).over(Window.partitionBy("rec"))
    half = df.withColumns({"_size": size, "_turn": F.col("n") * (2 * math.pi / fs) * nominal}).withColumn("_half", (F.col("n") >= F.floor(F.col("_size") / 2)).cast("int")).where(F.col("n") < 2 * F.floor(F.col("_size") / 2))
    part = lambda f, k: F.sum(F.when(F.col("_half") == k, F.col("x") * f("_turn")))
    sums = half.groupBy("rec").agg(F.max("_size").alias("size"), F.max(nominal).alias("f0"), *[part(f, k).alias(f"{name}{k}") for k in (0, 1) for f, name in ((F.cos, "c"), (F.sin, "s"))])
    drift = F.atan2(-F.col("s1"), F.col("c1")) - F.atan2(-F.col("s0"), F.col("c0"))
    wrapped = drift - 2 * math.pi * F.round(drift / (2 * math.pi))
    return sums.select("rec", (F.col("f0") + wrapped / (2 * math.pi * F.floor(F.col("size") / 2) / fs)).alias("hz"))
