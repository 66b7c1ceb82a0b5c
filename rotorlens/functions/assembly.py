"""From a recording's arrays to the tensor that the network reads; NumPy, one recording at a time."""

from __future__ import annotations

import numpy as np

from . import kernels

# Pole pairs, notched supply harmonics and their half-width, bands, decimation, bins and orders.
POLES, HARMONICS, NOTCH_HZ = 4, 8, 2.5
LOW_BAND, HIGH_BAND, RAW_BAND = (500.0, 2500.0), (2500.0, 10000.0), (200.0, 16000.0)
CURRENT_STEP, VIBRATION_STEP = 16, 2
BINS, ORDERS, TINY = 512, 16.0, 1e-12


def shaft_speed(current: np.ndarray, fs: float, low: float = 20.0, high: float = 200.0, poles: int = POLES) -> tuple[float, float]:
    """Shaft and electrical frequency, from the current alone."""
    electrical = kernels.fundamental(current, fs, low, high)
    return electrical / poles, electrical


def speed_error(estimated_hz: float, speed_rpm: np.ndarray) -> float:
    measured = float(np.mean(speed_rpm)) / 60
    return abs(estimated_hz - measured) / measured if measured > 0 else float("nan")


def _spectrum(x: np.ndarray, fs: float) -> tuple[np.ndarray, np.ndarray]:
    x = np.asarray(x, float)
    return np.fft.rfftfreq(len(x), 1 / fs), np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) * 2 / len(x)


def _notched(f: np.ndarray, m: np.ndarray, electrical: float) -> np.ndarray:
    centres = np.arange(1, HARMONICS + 1) * electrical
    centres = centres[centres <= f[-1]]
    return np.where((np.abs(f[:, None] - centres) <= NOTCH_HZ).any(1), 0.0, m)


def _read(f: np.ndarray, m: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.interp(at, f, m, left=0.0, right=0.0)


def sideband_orders(x: np.ndarray, fs: float, shaft: float, electrical: float, bins: int = BINS, orders: float = ORDERS) -> np.ndarray:
    """Upper plus lower sideband around the supply at each shaft order, over the fundamental; the supply is notched."""
    if shaft <= 0 or electrical <= 0:
        return np.zeros(bins)
    f, m = _spectrum(x, fs)
    clean, away = _notched(f, m, electrical), np.arange(bins) * (orders / bins) * shaft
    return (_read(f, clean, electrical + away) + _read(f, clean, np.abs(electrical - away))) / (float(np.interp(electrical, f, m)) + TINY)


def raw_orders(x: np.ndarray, fs: float, shaft: float, electrical: float | None = None, bins: int = BINS, orders: float = ORDERS) -> np.ndarray:
    """The spectrum itself on the shaft-order axis, with the supply notched if it is known."""
    if shaft <= 0:
        return np.zeros(bins)
    f, m = _spectrum(x, fs)
    return _read(f, _notched(f, m, electrical) if electrical and electrical > 0 else m, np.arange(bins) * (orders / bins) * shaft)


def log_bands(x: np.ndarray, fs: float, band: tuple[float, float] = RAW_BAND, bins: int = BINS) -> np.ndarray:
    """Root of the power between logarithmic edges, from its lower edge up to below the next."""
    x = np.asarray(x, float)
    high = min(band[1], 0.98 * fs / 2)
    if high <= band[0]:
        return np.zeros(bins)
    f, power = np.fft.rfftfreq(len(x), 1 / fs), np.abs(np.fft.rfft((x - x.mean()) * np.hanning(len(x)))) ** 2
    place = np.searchsorted(np.geomspace(band[0], high, bins + 1), f, side="right") - 1
    inside = (place >= 0) & (place < bins)
    return np.sqrt(np.bincount(place[inside], power[inside], bins))


def conditioned(spectrum: np.ndarray) -> np.ndarray:
    typical = float(np.median(spectrum))
    if not np.isfinite(typical) or typical <= TINY:
        typical = float(np.mean(np.abs(spectrum))) or 1.0
    return np.log1p(spectrum / (typical + TINY))


def window_tensor(currents, low: np.ndarray, high: np.ndarray, vibration: np.ndarray, fs_current: float, fs_vibration: float, search: tuple[float, float] = (20.0, 200.0), bins: int = BINS, orders: float = ORDERS, raw: tuple[float, float] = RAW_BAND) -> tuple[np.ndarray, dict]:
    """(5, bins): sidebands and raw orders of the currents' mean, both envelopes by order, and logarithmic bands."""
    shaft, electrical = shaft_speed(currents[0], fs_current, *search)
    both = lambda make: np.mean([make(x, fs_current, shaft, electrical, bins, orders) for x in currents], axis=0)
    rows = [both(sideband_orders), both(raw_orders), *(kernels.order_spectrum(e, fs_vibration, shaft, bins, orders) for e in (low, high)), log_bands(vibration, fs_vibration, raw, bins)]
    return np.stack([conditioned(r) for r in rows]).astype(np.float32), {"fr_hz": shaft, "f_elec_hz": electrical, "rpm": shaft * 60}


def recording_tensor(currents, vibration: np.ndarray, fs: float, window_s: float = 1.0, hop_s: float = 0.5, steps: tuple[int, int] = (CURRENT_STEP, VIBRATION_STEP), bands=(LOW_BAND, HIGH_BAND), **how) -> tuple[np.ndarray, list[dict]]:
    """(windows, 5, bins) and each window's speeds. Filters run once over the recording, then it is cut."""
    fs_c, fs_v = fs / steps[0], fs / steps[1]
    currents = [kernels.decimate(np.asarray(x, float), steps[0]) if steps[0] > 1 else np.asarray(x, float) for x in currents]
    vibration = kernels.decimate(np.asarray(vibration, float), steps[1]) if steps[1] > 1 else np.asarray(vibration, float)
    w_c, h_c, w_v, h_v = (int(round(s * f)) for f in (fs_c, fs_v) for s in (window_s, hop_s))
    size = min(map(len, currents))
    if size < w_c or len(vibration) < w_v:
        return np.zeros((0, 5, how.get("bins", BINS)), np.float32), []
    envelopes = [kernels.envelope(vibration, fs_v, *band) for band in bands]
    made = []
    for k in range(min(1 + (size - w_c) // h_c, 1 + (len(vibration) - w_v) // h_v)):
        c, v = slice(k * h_c, k * h_c + w_c), slice(k * h_v, k * h_v + w_v)
        made.append(window_tensor([x[c] for x in currents], envelopes[0][v], envelopes[1][v], vibration[v], fs_c, fs_v, **how))
    return np.stack([x for x, _ in made]), [d for _, d in made]


def supply_orders(x: np.ndarray, fs: float, electrical: float, bins: int = 512, orders: float = 20.0) -> np.ndarray:
    """Mean magnitude of the phases (rows of x) on the axis of supply orders, over its floored median, in logarithms."""
    found = [_spectrum(phase, fs) for phase in x]
    f, m = found[0][0], np.mean([m for _, m in found], axis=0)
    read = _read(f, m, np.arange(bins) * (orders / bins) * electrical)
    scale = max(float(np.median(read)), 1e-6 * float(read.max()))
    return np.log1p(read / scale) if scale > 0 else np.zeros(bins)
