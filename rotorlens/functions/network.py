"""The one-dimensional convolutional network: forward, training, folding, integer twin and memory words; NumPy.

Arrays are (rows, channels, length). A stage is a convolution with half-width padding, batch normalisation and
ReLU; then comes the mean over length and one linear layer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .boosting import softmax

# Fixed values: (channels out, width, stride) of the deployed network, and the integer ranges.
STAGES = ((16, 9, 2), (32, 7, 2), (64, 5, 2), (64, 3, 2))
LARGEST, EPS = 127, 1e-5


@dataclass
class Stage:
    w: np.ndarray  # out, in, width
    b: np.ndarray
    stride: int
    #: gamma, beta, running mean and running variance; None once folded.
    norm: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None

    @property
    def width(self) -> int:
        return self.w.shape[2]


@dataclass
class Network:
    stages: list[Stage]
    w: np.ndarray  # classes, channels
    b: np.ndarray
    trace: list = field(default_factory=list, repr=False)


def built(channels: int, classes: int, stages=STAGES, seed: int = 0) -> Network:
    rng, made = np.random.default_rng(seed), []
    for out, width, stride in stages:
        bound = 1 / np.sqrt(channels * width)
        made.append(Stage(rng.uniform(-bound, bound, (out, channels, width)), rng.uniform(-bound, bound, out), stride, (np.ones(out), np.zeros(out), np.zeros(out), np.ones(out))))
        channels = out
    bound = 1 / np.sqrt(channels)
    return Network(made, rng.uniform(-bound, bound, (classes, channels)), rng.uniform(-bound, bound, classes))


def patches(x: np.ndarray, width: int, stride: int) -> np.ndarray:
    """(rows, places, channels * width) of x with half-width zeros at both ends."""
    padded = np.pad(x, ((0, 0), (0, 0), (width // 2, width // 2)))
    view = np.lib.stride_tricks.sliding_window_view(padded, width, axis=2)[:, :, ::stride]
    return view.transpose(0, 2, 1, 3).reshape(x.shape[0], view.shape[2], -1)


def convolved(x: np.ndarray, stage: Stage) -> np.ndarray:
    return (patches(x, stage.width, stage.stride) @ stage.w.reshape(len(stage.w), -1).T + stage.b).transpose(0, 2, 1)


def stage_forward(x: np.ndarray, stage: Stage) -> np.ndarray:
    y = convolved(x, stage)
    if stage.norm is not None:
        gamma, beta, mean, var = stage.norm
        y = (y - mean[:, None]) * (gamma / np.sqrt(var + EPS))[:, None] + beta[:, None]
    return np.maximum(y, 0.0)


def forward(net: Network, x: np.ndarray) -> np.ndarray:
    for stage in net.stages:
        x = stage_forward(x, stage)
    return x.mean(axis=2) @ net.w.T + net.b


def parameters(net: Network) -> int:
    norms = sum(2 * len(s.b) for s in net.stages if s.norm is not None)
    return sum(s.w.size + s.b.size for s in net.stages) + norms + net.w.size + net.b.size


def multiplications(net: Network, length: int) -> int:
    total = net.w.size
    for s in net.stages:
        length = (length + 2 * (s.width // 2) - s.width) // s.stride + 1
        total += s.w.size * length
    return total


def folded(net: Network) -> Network:
    """The same function with the normalisation inside the convolutions."""
    made = []
    for s in net.stages:
        if s.norm is None:
            made.append(s)
            continue
        gamma, beta, mean, var = s.norm
        scale = gamma / np.sqrt(var + EPS)
        made.append(Stage(s.w * scale[:, None, None], (s.b - mean) * scale + beta, s.stride))
    return Network(made, net.w, net.b)


def averaged(net: Network, x: np.ndarray, shifts=(0,)) -> np.ndarray:
    """Class probabilities, averaged over cyclic shifts of the last axis."""
    return np.mean([softmax(forward(net, np.roll(x, s, axis=2))) for s in shifts], axis=0)


# -- training -------------------------------------------------------------------------------------------------
def augmented(x: np.ndarray, rng, prob: float = 0.5, jitter: int = 2, gain: float = 0.1, dropout: float = 0.1, noise: float = 0.02) -> np.ndarray:
    """Some rows shifted along the order axis, rescaled channel by channel, with a channel silenced, and with noise."""
    n, channels, length = x.shape
    hit = rng.random(n) < prob
    shift = rng.integers(-jitter, jitter + 1, n) * hit if jitter else np.zeros(n, int)
    x = np.take_along_axis(x, ((np.arange(length)[None] - shift[:, None]) % length)[:, None, :].repeat(channels, 1), 2)
    x = x * np.where(hit[:, None, None], 1 + gain * rng.uniform(-1, 1, (n, channels, 1)), 1.0)
    if channels > 1:
        mute = hit & (rng.random(n) < dropout)
        x[np.flatnonzero(mute), rng.integers(0, channels, n)[mute]] = 0.0
    return x + noise * rng.normal(size=x.shape) * hit[:, None, None]


def _train_forward(net: Network, x: np.ndarray, momentum: float = 0.1) -> tuple[np.ndarray, list]:
    tape = []
    for s in net.stages:
        columns = patches(x, s.width, s.stride)
        y = columns @ s.w.reshape(len(s.w), -1).T + s.b
        mean, var = y.mean((0, 1)), y.var((0, 1))
        gamma, beta, run_mean, run_var = s.norm
        n = y.shape[0] * y.shape[1]
        s.norm = (gamma, beta, (1 - momentum) * run_mean + momentum * mean, (1 - momentum) * run_var + momentum * var * n / max(1, n - 1))
        unit = (y - mean) / np.sqrt(var + EPS)
        out = np.maximum(unit * gamma + beta, 0.0)
        tape.append((x.shape, columns, unit, np.sqrt(var + EPS), out > 0))
        x = out.transpose(0, 2, 1)
    return x, tape


def gradients(net: Network, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and its gradient in the order of values(); target: class shares, weight: of each row."""
    top, tape = _train_forward(net, x)
    pooled = top.mean(2)
    p = softmax(pooled @ net.w.T + net.b)
    weight = weight / weight.sum()
    loss = float(-(weight[:, None] * target * np.log(np.maximum(p, 1e-30))).sum())
    e = weight[:, None] * (p * target.sum(1, keepdims=True) - target)
    found = [e.T @ pooled, e.sum(0)]
    down = np.repeat((e @ net.w)[:, None, :], top.shape[2], 1) / top.shape[2]
    for s, (shape, columns, unit, std, alive) in zip(reversed(net.stages), reversed(tape)):
        gamma = s.norm[0]
        down = down * alive
        d_gamma, d_beta = (down * unit).sum((0, 1)), down.sum((0, 1))
        n = down.shape[0] * down.shape[1]
        d_y = gamma / std * (down - d_beta / n - unit * d_gamma / n)
        flat = d_y.reshape(-1, d_y.shape[2])
        d_w = (flat.T @ columns.reshape(-1, columns.shape[2])).reshape(s.w.shape)
        found = [d_w, flat.sum(0), d_gamma, d_beta, *found]
        back = (d_y @ s.w.reshape(len(s.w), -1)).reshape(*d_y.shape[:2], shape[1], s.width)
        padded = np.zeros((shape[0], shape[1], shape[2] + 2 * (s.width // 2)))
        for k in range(s.width):
            padded[:, :, k : k + s.stride * d_y.shape[1] : s.stride] += back[..., k].transpose(0, 2, 1)
        down = padded[:, :, s.width // 2 : s.width // 2 + shape[2]].transpose(0, 2, 1)
    return loss, found


def values(net: Network) -> list[np.ndarray]:
    return [v for s in net.stages for v in (s.w, s.b, s.norm[0], s.norm[1])] + [net.w, net.b]


def trained(x: np.ndarray, y: np.ndarray, classes: int, stages=STAGES, epochs: int = 20, batch: int = 128, rate: float = 3e-3, decay: float = 1e-2, smoothing: float = 0.05, seed: int = 0, augment: dict | None = None) -> Network:
    """AdamW under a one-cycle rate, on class-weighted, smoothed labels."""
    net, rng = built(x.shape[1], classes, stages, seed), np.random.default_rng([seed, 1])
    counts = np.bincount(y, minlength=classes)
    weight = np.where(counts > 0, len(y) / (np.maximum(counts, 1) * (counts > 0).sum()), 0.0)
    target = np.eye(classes)[y] * (1 - smoothing) + smoothing / classes
    params = values(net)
    first, second = [np.zeros_like(v) for v in params], [np.zeros_like(v) for v in params]
    steps = epochs * -(-len(y) // batch)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            rows = order[at : at + batch]
            part = augmented(x[rows], rng, **augment) if augment else x[rows]
            _, found = gradients(net, part, target[rows], weight[y[rows]])
            step += 1
            share = step / steps
            now = rate * (0.04 + 0.96 * (1 - np.cos(np.pi * share / 0.3)) / 2 if share < 0.3 else (1 + np.cos(np.pi * (share - 0.3) / 0.7)) / 2)
            for v, g, m, s in zip(params, found, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v *= 1 - now * decay
                v -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


# -- integers -------------------------------------------------------------------------------------------------
@dataclass
class IntegerLayer:
    name: str
    w: np.ndarray
    b: np.ndarray
    w_scale: np.ndarray
    x_scale: float
    stride: int = 1

    @property
    def terms(self) -> int:
        return int(np.prod(self.w.shape[1:]))

    @property
    def peak(self) -> int:
        """The largest magnitude that its accumulator can reach."""
        return self.terms * (LARGEST + 1) * LARGEST + int(np.abs(self.b.astype(np.int64)).max())

    @property
    def bits(self) -> int:
        return int(np.ceil(np.log2(self.peak + 1))) + 1


def scale_of(x: np.ndarray, percentile: float = 99.9) -> float:
    top = float(np.percentile(np.abs(x), percentile))
    return top / LARGEST if top > 0 else 1.0


def integers(x: np.ndarray, scale) -> np.ndarray:
    return np.clip(np.rint(x / scale), -LARGEST - 1, LARGEST).astype(np.int32)


def calibrated(net: Network, x: np.ndarray, percentile: float = 99.9) -> list[float]:
    """Scale of the input and of what leaves each stage, on the folded network."""
    found = [scale_of(x, percentile)]
    for stage in folded(net).stages:
        x = stage_forward(x, stage)
        found.append(scale_of(x, percentile))
    return found


def quantised(net: Network, x: np.ndarray, percentile: float = 99.9, per_channel: bool = True) -> list[IntegerLayer]:
    net, scales = folded(net), calibrated(net, x, percentile)
    parts = [(f"conv{k + 1}", s.w, s.b, s.stride) for k, s in enumerate(net.stages)] + [("fc", net.w, net.b, 1)]
    layers = []
    for (name, w, b, stride), scale in zip(parts, scales):
        top = np.abs(w).reshape(len(w), -1).max(1) if per_channel else np.full(len(w), np.abs(w).max())
        s = np.where(top > 0, top / LARGEST, 1.0)
        limit = 2**31
        layer = IntegerLayer(name, integers(w, s.reshape(-1, *[1] * (w.ndim - 1))), np.clip(np.rint(b / (s * scale)), -limit, limit - 1).astype(np.int32), s, scale, stride)
        if layer.peak >= limit:
            raise ValueError(f"{name}: the accumulator can reach {layer.peak}")
        layers.append(layer)
    return layers


def integer_forward(layers: list[IntegerLayer], x: np.ndarray) -> np.ndarray:
    for layer in layers[:-1]:
        q = patches(integers(x, layer.x_scale), layer.w.shape[2], layer.stride)
        acc = q.astype(np.int64) @ layer.w.reshape(len(layer.w), -1).T.astype(np.int64) + layer.b
        x = np.maximum(acc * (layer.w_scale * layer.x_scale), 0.0).transpose(0, 2, 1)
    last = layers[-1]
    acc = integers(x.mean(2), last.x_scale).astype(np.int64) @ last.w.T.astype(np.int64) + last.b
    return acc * (last.w_scale * last.x_scale)
