"""The band-split transformer in numpy, over one window or over a table of windows.

Sizes are parameters, so a small network with random weights runs in tests; the
names and shapes at full size are those of `weights.expected`. Arithmetic follows
the layers' order: scale, maximum, softmax in attention; the norm floored by a
maximum; GELU by the error function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from ..errors import ModelError
from . import spectral

_ERF = np.vectorize(math.erf, otypes=[float])


def hz_to_mel(hz: float) -> float:
    step = 200.0 / 3
    return hz / step if hz < 1000 else 15.0 + math.log(hz / 1000) / (math.log(6.4) / 27)


def mel_to_hz(mel: float) -> float:
    return 200.0 / 3 * mel if mel < 15 else 1000 * math.exp(math.log(6.4) / 27 * (mel - 15))


@dataclass(frozen=True)
class Shape:
    """Sizes of a network."""

    bands: int = 60
    n_fft: int = 2048
    hop: int = 441
    rate: int = 44_100
    dim: int = 384
    heads: int = 8
    head_dim: int = 64
    depth: int = 6
    mult: int = 4
    mask_layers: int = 3

    @property
    def bins(self) -> int:
        return self.n_fft // 2 + 1

    @cached_property
    def band_bins(self) -> list[np.ndarray]:
        """Bins of each band: triangles on the mel scale, the ends forced in."""
        top = self.rate / 2
        edge = np.array([mel_to_hz(hz_to_mel(top) / (self.bands + 1) * k) for k in range(self.bands + 2)])
        f = np.linspace(0, top, self.bins)
        held = [set(np.flatnonzero(np.minimum((f - a) / (b - a), (c - f) / (c - b)) > 0).tolist()) for a, b, c in zip(edge, edge[1:], edge[2:], strict=False)]
        held[0].add(0)
        held[-1].add(self.bins - 1)
        return [np.array(sorted(h)) for h in held]

    @cached_property
    def cover(self) -> np.ndarray:
        """How many bands hold each bin."""
        return np.bincount(np.concatenate(self.band_bins), minlength=self.bins)

    @cached_property
    def tensors(self) -> dict[str, tuple[int, ...]]:
        d, inner, hidden = self.dim, self.heads * self.head_dim, self.mult * self.dim
        out: dict[str, tuple[int, ...]] = {}
        for b, bins in enumerate(self.band_bins):
            n = 4 * len(bins)
            out |= {f"band_split.to_features_{b}.norm.weight": (n,), f"band_split.to_features_{b}.linear.weight": (n, d), f"band_split.to_features_{b}.linear.bias": (d,)}
        for i in range(self.depth):
            for axis in ("time_transformer", "freq_transformer"):
                p, q = f"layers_{i}.{axis}.layers_0.", f"layers_{i}.{axis}."
                out |= {p + "attn.norm.weight": (d,), p + "attn.to_qkv.weight": (d, 3 * inner), p + "attn.to_gates.weight": (d, self.heads), p + "attn.to_gates.bias": (self.heads,), p + "attn.to_out.layers.0.weight": (inner, d)}
                out |= {p + "ff.net.layers.0.weight": (d,), p + "ff.net.layers.1.weight": (d, hidden), p + "ff.net.layers.1.bias": (hidden,), p + "ff.net.layers.4.weight": (hidden, d), p + "ff.net.layers.4.bias": (d,), q + "norm.weight": (d,)}
        for b, bins in enumerate(self.band_bins):
            widths = [d, *[hidden] * (self.mask_layers - 1), 8 * len(bins)]
            for k in range(self.mask_layers):
                p = f"mask_estimators_0.to_freqs_{b}.layers.{2 * k}."
                out |= {p + "weight": (widths[k], widths[k + 1]), p + "bias": (widths[k + 1],)}
        return out

    def random(self, seed: int = 0) -> dict[str, np.ndarray]:
        """Weights that keep signals in range; norms are 1."""
        rng = np.random.default_rng(seed)
        return {k: np.ones(s) if ".norm." in k or k.endswith("net.layers.0.weight") else rng.normal(0, s[0] ** -0.5, s) for k, s in self.tensors.items()}


def load_weights(shape: Shape, found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """found with two-dimensional tensors turned to [in, out]; every name and shape must match."""
    if extra := sorted(found.keys() - shape.tensors.keys()):
        raise ModelError(f"{len(extra)} tensors are unknown, among them {extra[:10]}")
    if missing := sorted(shape.tensors.keys() - found.keys()):
        raise ModelError(f"{len(missing)} tensors are missing, among them {missing[:10]}")
    out = {}
    for key, want in shape.tensors.items():
        x = found[key].T if found[key].ndim == 2 else found[key]
        if x.shape != want:
            raise ModelError(f"{key} is {x.shape}, not {want}")
        out[key] = np.asarray(x, float)
    return out


def l2_norm(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.maximum(norm, 1e-12) * math.sqrt(x.shape[-1]) * weight


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + _ERF(x * math.sqrt(0.5)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def rope(x: np.ndarray, base: float = 10000.0) -> np.ndarray:
    """(..., places, dim): pairs (2i, 2i+1) turned by place / base ** (2i / dim)."""
    n, d = x.shape[-2:]
    angle = np.arange(n)[:, None] / base ** (np.arange(0, d, 2) / d)[None, :]
    out = np.empty_like(x)
    a, b = x[..., 0::2], x[..., 1::2]
    out[..., 0::2] = a * np.cos(angle) - b * np.sin(angle)
    out[..., 1::2] = a * np.sin(angle) + b * np.cos(angle)
    return out


class Network:
    """One source's network: gives the masked mix of a stereo window."""

    def __init__(self, shape: Shape, weights: dict[str, np.ndarray]):
        self.s, self.w = shape, weights

    def _attention(self, x: np.ndarray, p: str) -> np.ndarray:
        s, w = self.s, self.w
        h = l2_norm(x, w[p + "attn.norm.weight"])
        batch, n, _ = h.shape
        q, k, v = (t.reshape(batch, n, s.heads, s.head_dim).transpose(0, 2, 1, 3) for t in np.split(h @ w[p + "attn.to_qkv.weight"], 3, axis=-1))
        scores = rope(q) @ rope(k).transpose(0, 1, 3, 2) * s.head_dim**-0.5
        e = np.exp(scores - scores.max(axis=-1, keepdims=True))
        mixed = e / e.sum(axis=-1, keepdims=True) @ v
        gates = sigmoid(h @ w[p + "attn.to_gates.weight"] + w[p + "attn.to_gates.bias"])
        mixed = mixed * gates.transpose(0, 2, 1)[..., None]
        return mixed.transpose(0, 2, 1, 3).reshape(batch, n, -1) @ w[p + "attn.to_out.layers.0.weight"]

    def _transformer(self, x: np.ndarray, i: int, axis: str) -> np.ndarray:
        p, w = f"layers_{i}.{axis}.layers_0.", self.w
        x = x + self._attention(x, p)
        h = gelu(l2_norm(x, w[p + "ff.net.layers.0.weight"]) @ w[p + "ff.net.layers.1.weight"] + w[p + "ff.net.layers.1.bias"])
        x = x + h @ w[p + "ff.net.layers.4.weight"] + w[p + "ff.net.layers.4.bias"]
        return l2_norm(x, w[f"layers_{i}.{axis}.norm.weight"])

    def _mask(self, x: np.ndarray, b: int) -> np.ndarray:
        for k in range(self.s.mask_layers):
            p = f"mask_estimators_0.to_freqs_{b}.layers.{2 * k}."
            x = x @ self.w[p + "weight"] + self.w[p + "bias"]
            x = np.tanh(x) if k + 1 < self.s.mask_layers else x
        value, gate = np.split(x, 2, axis=-1)
        return value * sigmoid(gate)

    def masks(self, spec: np.ndarray) -> np.ndarray:
        """(bins, 2, frames) complex masks of a (2, bins, frames) spectrum."""
        s = self.s
        parts = np.stack([spec.real, spec.imag], axis=-1).transpose(2, 1, 0, 3)  # frame, bin, channel, part
        bands = []
        for b, bins in enumerate(s.band_bins):
            p = f"band_split.to_features_{b}."
            f = parts[:, bins].reshape(len(parts), -1)
            bands.append(l2_norm(f, self.w[p + "norm.weight"]) @ self.w[p + "linear.weight"] + self.w[p + "linear.bias"])
        x = np.stack(bands)  # band, frame, dim
        for i in range(s.depth):
            x = self._transformer(x, i, "time_transformer")
            x = self._transformer(x.transpose(1, 0, 2), i, "freq_transformer").transpose(1, 0, 2)
        total = np.zeros((s.bins, 2, spec.shape[2]), complex)
        for b, bins in enumerate(s.band_bins):
            m = self._mask(x[b], b).reshape(-1, len(bins), 2, 2)
            np.add.at(total, bins, (m[..., 0] + 1j * m[..., 1]).transpose(1, 2, 0))
        return total / np.maximum(s.cover, 1e-8)[:, None, None]

    def forward(self, mix: np.ndarray) -> np.ndarray:
        """(2, samples) in and out."""
        spec = np.stack([spectral.stft(c, self.s.n_fft, self.s.hop) for c in mix.astype(float)])
        masked = spec * self.masks(spec).transpose(1, 0, 2)
        return np.stack([spectral.istft(c, mix.shape[1], self.s.n_fft, self.s.hop) for c in masked])


class NetworkSeparator:
    """A Separator of a Network: background is what vocals leave."""

    name = "network"

    def __init__(self, net: Network, window_samples: int):
        self.net, self.window_samples, self.sample_rate = net, window_samples, net.s.rate

    def separate(self, mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vocals = self.net.forward(mix)
        return vocals, mix - vocals
