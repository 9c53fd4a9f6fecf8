"""Windowed-sinc resampling of a mono signal, whole or block by block.

The filter is this library's own: `LENGTH` taps of a sinc cut off at `CUTOFF` of the
lower rate, under a squared Hann window. It has the usual properties (pass band,
length, independence of the block size), not the bits of any other filter.
"""

from __future__ import annotations

import math

import numpy as np

from ..errors import ResampleError

LENGTH, CUTOFF = 128, 0.913


def _taps(offset: np.ndarray, cut: float) -> np.ndarray:
    """Weights at distances `offset` (source samples) from an output sample."""
    w = np.cos(np.pi * offset / LENGTH) ** 2
    return np.where(np.abs(offset) <= LENGTH / 2, cut * np.sinc(cut * offset) * w * w, 0.0)


class StreamingSinc:
    """Push blocks, then finish: together ceil(frames * ratio) samples, whatever the blocks."""

    def __init__(self, from_rate: int, to_rate: int):
        if from_rate <= 0 or to_rate <= 0:
            raise ResampleError(f"can't resample {from_rate} to {to_rate}")
        self.from_rate, self.to_rate = from_rate, to_rate
        self.cut = CUTOFF * min(1.0, to_rate / from_rate)
        self.held = np.zeros(LENGTH // 2)  # silence before the first sample
        self.first = -(LENGTH // 2)  # source index of held[0]
        self.seen = 0
        self.made = 0

    def _make(self, until: int) -> np.ndarray:
        """Output samples up to the one at index until (exclusive)."""
        n = max(until - self.made, 0)
        if not n:
            return np.zeros(0, np.float32)
        i = np.arange(self.made, until)
        at = i * self.from_rate // self.to_rate
        frac = (i * self.from_rate % self.to_rate) / self.to_rate
        k = np.arange(-(LENGTH // 2) + 1, LENGTH // 2 + 1)
        index = at[:, None] + k[None, :] - self.first
        ok = (index >= 0) & (index < len(self.held))
        weights = _taps(k[None, :] - frac[:, None], self.cut)
        out = (np.where(ok, self.held[np.clip(index, 0, len(self.held) - 1)], 0.0) * weights).sum(axis=1)
        self.made = until
        drop = max(int(until * self.from_rate // self.to_rate) - LENGTH // 2 - self.first, 0)
        self.held, self.first = self.held[drop:], self.first + drop
        return out.astype(np.float32)

    def push(self, block: np.ndarray) -> np.ndarray:
        self.held = np.append(self.held, block.astype(float))
        self.seen += len(block)
        ready = max(self.seen - LENGTH // 2, 0)  # the last samples still wait for their right side
        return self._make(math.ceil(ready * self.to_rate / self.from_rate))

    def finish(self) -> np.ndarray:
        return self._make(math.ceil(self.seen * self.to_rate / self.from_rate))


def resample(signal: np.ndarray, from_rate: int, to_rate: int, block: int | None = None) -> np.ndarray:
    """The same rate gives the signal itself."""
    if from_rate == to_rate:
        return np.asarray(signal, np.float32)
    sinc = StreamingSinc(from_rate, to_rate)
    block = block or max(len(signal), 1)
    parts = [sinc.push(signal[i : i + block]) for i in range(0, len(signal), block)]
    return np.concatenate([*parts, sinc.finish()])


def resample_tracks(frames, keys: list[str], from_rate: int, to_rate: int, block: int = 65_536):
    """keys, pos, v of each track at another rate; frames: keys, pos, v.

    A track is cut into blocks that overlap by the filter's length, so one long
    track spreads over many tasks.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    if from_rate == to_rate:
        return frames.select(*keys, "pos", "v")
    half = LENGTH
    step = block - block % from_rate or from_rate  # blocks start where both rates meet
    cut = frames.withColumn("__b", F.explode(F.sequence(F.greatest(F.floor((F.col("pos") - half) / step), F.lit(0)), F.floor((F.col("pos") + half) / step))))
    kinds = ", ".join(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys)

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        b, start = int(pdf["__b"].iloc[0]), int(pdf.pos.iloc[0])
        end = min((b + 1) * step, int(pdf.pos.iloc[-1]) + 1)
        i = np.arange(math.ceil(b * step * to_rate / from_rate), math.ceil(end * to_rate / from_rate))
        sinc = StreamingSinc(from_rate, to_rate)
        sinc.held, sinc.first, sinc.made = pdf.v.to_numpy(float), start, int(i[0]) if len(i) else 0
        out = {k: [pdf[k].iloc[0]] * len(i) for k in keys}
        return pd.DataFrame({**out, "pos": i, "v": sinc._make(int(i[-1]) + 1).astype(float) if len(i) else []})

    return cut.groupBy(*keys, "__b").applyInPandas(go, f"{kinds}, pos long, v double")
