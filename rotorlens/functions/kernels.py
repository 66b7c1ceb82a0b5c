"""NumPy kernels for what SQL cannot say: zero-phase filters, analytic signals, ridges, integer convolutions.

Each runs on one recording's array inside an Arrow batch; keep recordings, not samples, as rows there.
"""

from __future__ import annotations

import numpy as np


def squared_bandpass(n: int, fs: float, low: float, high: float, order: int = 4) -> np.ndarray:
    """|H|^2 of a Butterworth band-pass on the one-sided grid: what filtering forward and back does, edges aside."""
    nyquist = fs / 2
    low, high = max(low, 1e-3 * nyquist), min(high, 0.999 * nyquist)
    if low >= high:
        raise ValueError("the band is empty")
    f = np.fft.rfftfreq(n, 1 / fs)
    warp = lambda x: np.tan(np.pi * np.minimum(x, 0.999 * nyquist) / fs)
    w, a, b = warp(f), warp(low), warp(high)
    with np.errstate(divide="ignore"):
        detune = (w * w - a * b) / (np.maximum(w, 1e-30) * (b - a))
    return 1 / (1 + detune ** (2 * order))


def analytic(x: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    n = len(x)
    half = np.fft.rfft(x) * (1 if weight is None else weight)
    full = np.zeros(n, complex)
    full[: len(half)] = half
    full[1 : (n + 1) // 2] *= 2
    return np.fft.ifft(full)


def envelope(x: np.ndarray, fs: float, low: float, high: float) -> np.ndarray:
    e = np.abs(analytic(x, squared_bandpass(len(x), fs, low, high)))
    return e - e.mean()


def decimate(x: np.ndarray, factor: int) -> np.ndarray:
    """Zero-phase low-pass at 0.8 of the new Nyquist rate (order-8 Chebyshev magnitude, squared), then a stride."""
    n = len(x)
    f = np.fft.rfftfreq(n) * 2 * factor / 0.8
    ripple = 10 ** (0.05 / 10) - 1
    t = np.where(f <= 1, np.cos(8 * np.arccos(np.clip(f, 0, 1))), np.cosh(8 * np.arccosh(np.maximum(f, 1))))
    with np.errstate(over="ignore"):
        return np.fft.irfft(np.fft.rfft(x) / (1 + ripple * t * t), n)[::factor]


def order_spectrum(x: np.ndarray, fs: float, shaft_hz: float, n_bins: int = 512, order_max: float = 16.0) -> np.ndarray:
    """Hann magnitude (2/n) read at equal steps of shaft orders; 0 beyond the last frequency or without rotation."""
    if shaft_hz <= 0:
        return np.zeros(n_bins)
    n = len(x)
    m = np.abs(np.fft.rfft(x * np.hanning(n))) * 2 / n
    f = np.fft.rfftfreq(n, 1 / fs)
    at = np.arange(n_bins) * order_max / n_bins * shaft_hz
    return np.interp(at, f, m, left=0.0, right=0.0)


def fundamental(x: np.ndarray, fs: float, low: float = 20.0, high: float = 200.0) -> float:
    n = len(x)
    m = np.abs(np.fft.rfft((x - x.mean()) * np.hanning(n)))
    f = np.fft.rfftfreq(n, 1 / fs)
    band = np.flatnonzero((f >= low) & (f <= high))
    if not len(band):
        raise ValueError("no bin lies in the band")
    k = int(band[m[band].argmax()])
    shift = 0.0
    if 0 < k < len(m) - 1:
        bend = m[k - 1] - 2 * m[k] + m[k + 1]
        shift = float(np.clip(0.5 * (m[k - 1] - m[k + 1]) / bend, -0.5, 0.5)) if bend else 0.0
    return (k + shift) * fs / n


def ridge(x: np.ndarray, fs: float, window_s: float = 0.25, hop_s: float = 0.05, low: float = 10.0, high: float = 500.0, taps: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Times and frequencies of the strongest bin in the band of each frame, moved by a parabola through logarithms.

    The parabola looks at neighbours within the band alone and moves as far as it says; a peak at the band's
    edge stays on its bin. Frames are weighed by a periodic Hann window; then a median filter smooths.
    """
    w, h = max(16, int(round(window_s * fs))), max(1, int(round(hop_s * fs)))
    f = np.fft.rfftfreq(w, 1 / fs)
    band = np.flatnonzero((f >= low) & (f <= high))
    if not len(band):
        raise ValueError("no bin lies in the band")
    if len(x) < w:
        return np.zeros(0), np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), w)[::h]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(w) / w)
    m = np.log(np.maximum(np.abs(np.fft.rfft(frames * hann, axis=1))[:, band] / hann.sum(), 1e-30))
    k = m.argmax(1)
    rows, inner = np.arange(len(m)), (k > 0) & (k < len(band) - 1)
    a, b, c = (m[rows, np.clip(k + d, 0, len(band) - 1)] for d in (-1, 0, 1))
    bend = a - 2 * b + c
    shift = np.where(inner & (bend != 0), 0.5 * (a - c) / np.where(bend == 0, 1, bend), 0.0)
    return (np.arange(len(m)) * h + w / 2) / fs, median_filter(f[band][k] + shift * fs / w, taps)


def median_filter(x: np.ndarray, taps: int) -> np.ndarray:
    """Running median with repeated edges; shorter arrays stay as they are."""
    if taps <= 1 or len(x) < taps:
        return x
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, taps // 2, mode="edge"), taps), axis=1)


def phase_frequency(x: np.ndarray, fs: float, centre: float, bandwidth: float = 20.0) -> float:
    """Slope of the unwrapped phase of the analytic signal within centre -+ bandwidth, in Hz."""
    f = np.fft.rfftfreq(len(x), 1 / fs)
    phase = np.unwrap(np.angle(analytic(np.asarray(x, float), ((f >= centre - bandwidth) & (f <= centre + bandwidth)).astype(float))))
    t = np.arange(len(x)) / fs
    t = t - t.mean()
    return float((t * (phase - phase.mean())).sum() / (t * t).sum() / (2 * np.pi))


def frequency_track(x: np.ndarray, fs: float, window_s: float = 0.25, hop_s: float = 0.05, low: float = 10.0, high: float = 500.0, limit: float = 2.0, refine: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The ridge, refined by the phase slope of the window around each time where the ridge is flat."""
    t, hz = ridge(x, fs, window_s, hop_s, low, high)
    w = max(16, int(round(window_s * fs)))
    if not refine or len(hz) < 3 or len(x) < w:
        return t, hz
    out = hz.copy()
    for j in np.flatnonzero(np.abs(np.gradient(hz, t)) <= limit):
        at = max(0, min(int(round(t[j] * fs)) - w // 2, len(x) - w))
        out[j] = phase_frequency(x[at : at + w], fs, hz[j])
    return t, out


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and end place of each maximal stretch of equal flags."""
    if not len(flags):
        return []
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(flags)]))


def envelope_segments(x: np.ndarray, fs: float, smooth_s: float = 0.05, on: float = 0.25, least_s: float = 0.20) -> list[tuple[str, float, float, float]]:
    """phase, t0, t1 and mean slope of the smoothed envelope's stretches; those under least_s are left out.

    Below `on` of the 95th percentile the machine is off: accel before a start, decel at the place where it stops.
    """
    n = max(1, int(round(smooth_s * fs)))
    e = np.convolve(np.abs(analytic(np.asarray(x, float) - np.mean(x))), np.ones(n) / n, mode="same")
    t = np.arange(len(e)) / fs
    top = float(np.percentile(e, 95))
    running, slope = e > on * top, np.gradient(e, t)
    steep = 0.5 * top / max(4 * smooth_s, 1e-6)
    stops = ~running & np.concatenate(([False], running[:-1]))
    flags = np.select([stops, ~running, slope > steep, slope < -steep], ["decel", "accel", "accel", "decel"], "cruise")
    return [(str(flags[a]), float(t[a]), float(t[b - 1]), float(slope[a:b].mean())) for a, b in runs(flags) if t[b - 1] - t[a] >= least_s]


def int8_conv(x: np.ndarray, w: np.ndarray, b: np.ndarray, w_scale: np.ndarray, x_scale: float) -> np.ndarray:
    """ReLU of an integer convolution (channels, length) with same padding, accumulated in 32 bits and scaled back."""
    k = w.shape[2]
    q = np.clip(np.rint(x / x_scale), -128, 127).astype(np.int32)
    q = np.pad(q, ((0, 0), (k // 2, k // 2)))
    columns = np.lib.stride_tricks.sliding_window_view(q, k, axis=1)
    acc = np.einsum("clk,ock->ol", columns, w.astype(np.int32)) + b[:, None].astype(np.int32)
    return np.maximum(acc * (w_scale * x_scale)[:, None], 0.0)
