"""Short-time Fourier transform and its inverse: numpy a track, and small ones in SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.signal import hann

N_FFT, HOP = 2048, 441


def window(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(x: np.ndarray, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """(bins, frames) of a signal, mirrored by half a window at both ends."""
    half = n_fft // 2
    i = np.arange(-half, len(x) + half)
    i = np.abs(i)
    i = np.where(i >= len(x), 2 * (len(x) - 1) - i, i)
    padded = x[np.clip(i, 0, max(len(x) - 1, 0))]
    n = 1 + len(x) // hop
    framed = padded[np.arange(n)[:, None] * hop + np.arange(n_fft)[None, :]] if n else np.zeros((0, n_fft))
    return np.fft.rfft(framed * window(n_fft), axis=1).T


def istft(spec: np.ndarray, length: int, n_fft: int = N_FFT, hop: int = HOP) -> np.ndarray:
    """Inverse of stft: overlap-add over the squared window, cut to length."""
    n = spec.shape[1]
    w = window(n_fft)
    framed = np.fft.irfft(spec.T, n_fft, axis=1) * w
    out, norm = np.zeros((n - 1) * hop + n_fft), np.zeros((n - 1) * hop + n_fft)
    for k in range(n):
        out[k * hop : k * hop + n_fft] += framed[k]
        norm[k * hop : k * hop + n_fft] += w * w
    out /= np.maximum(norm, 1e-12)
    half = n_fft // 2
    return out[half : half + length]


def framed(signal: DataFrame, keys: list[str], n_fft: int, hop: int) -> DataFrame:
    """keys, total, frame, k, v: every frame's samples, mirrored at the ends; signal: keys, pos, total, v.

    The frames of a sample follow from its position and its mirrored ones by arithmetic. There is
    no join, which Spark would broadcast: places made from a few rows count as small before they are made.
    """
    pos, total, at, half = F.col("pos"), F.col("total"), F.col("__at"), n_fft // 2
    none = F.array().cast("array<long>")
    left = F.when((pos > 0) & (pos <= half), F.array((-pos).cast("long"))).otherwise(none)
    right = F.when((pos < total - 1) & (pos >= total - 1 - n_fft), F.array((2 * (total - 1) - pos).cast("long"))).otherwise(none)
    places = signal.select(*keys, "total", "v", F.explode(F.concat(F.array(pos.cast("long")), left, right)).alias("__at"))
    first = F.greatest(F.floor((at + half - n_fft) / hop) + 1, F.lit(0)).cast("int")
    last = F.least(F.floor((at + half) / hop), F.floor(total / hop)).cast("int")
    rows = places.select("*", F.explode(F.when(first <= last, F.sequence(first, last))).alias("frame"))
    return rows.select(*keys, "total", "frame", (at + half - F.col("frame") * hop).cast("int").alias("k"), "v")


def _turns(f, by: list[int], n_fft: int) -> list:
    """For each of `by`, f of the turn of that bin and place, or place and bin: an array to look up by the other."""
    return [F.array(*[F.lit(f(2 * math.pi * b * k / n_fft)) for k in range(n_fft)]) for b in by]


def small_dft(signal: DataFrame, keys: list[str], n_fft: int, hop: int) -> DataFrame:
    """keys, total, frame, bin, re, im by the definition; for short windows.

    A frame's bins are summed side by side, so its samples aren't multiplied by the bins.
    """
    rows = framed(signal, keys, n_fft, hop).withColumn("x", F.col("v") * hann(F.col("k"), n_fft))
    bins = list(range(n_fft // 2 + 1))
    re, im = ([F.sum(part(F.col("x")) * F.get(t, F.col("k"))) for t in _turns(f, bins, n_fft)] for f, part in ((math.cos, lambda x: x), (math.sin, lambda x: -x)))
    spectra = rows.groupBy(*keys, "total", "frame").agg(*[c.alias(f"__{p}{b}") for p, cs in (("re", re), ("im", im)) for b, c in enumerate(cs)])
    each = F.inline(F.array(*[F.struct(F.lit(b).alias("bin"), F.col(f"__re{b}").alias("re"), F.col(f"__im{b}").alias("im")) for b in bins]))
    return spectra.select(*keys, "total", "frame", each)


def small_idft(spec: DataFrame, keys: list[str], n_fft: int, hop: int) -> DataFrame:
    """keys, pos, v: the inverse of small_dft by overlap-add over the squared window."""
    twice = F.when(F.col("bin").isin(0, n_fft // 2), 1.0).otherwise(2.0)
    places = list(range(n_fft))
    turns = zip(_turns(math.cos, places, n_fft), _turns(math.sin, places, n_fft), strict=True)
    ys = [(F.sum(twice * (F.col("re") * F.get(c, F.col("bin")) - F.col("im") * F.get(s, F.col("bin")))) / n_fft).alias(f"__y{k}") for k, (c, s) in enumerate(turns)]
    wide = spec.groupBy(*keys, "total", "frame").agg(*ys)
    samples = wide.select(*keys, "total", "frame", F.inline(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"__y{k}").alias("y")) for k in places])))
    w = hann(F.col("k"), n_fft)
    pos = F.col("frame") * hop + F.col("k") - n_fft // 2
    summed = samples.select(*keys, "total", pos.cast("long").alias("pos"), (F.col("y") * w).alias("y"), (w * w).alias("n")).filter((F.col("pos") >= 0) & (F.col("pos") < F.col("total")))
    return summed.groupBy(*keys, "pos").agg((F.sum("y") / F.greatest(F.sum("n"), F.lit(1e-12))).alias("v"))


def track_spectra(wins: DataFrame, keys: list[str], n_fft: int = N_FFT, hop: int = HOP) -> DataFrame:
    """keys, win_id, frame, re, im (arrays over the bins) of each window's left channel, by FFT."""
    import pandas as pd

    kinds = ", ".join(f"`{k}` {wins.schema[k].dataType.simpleString()}" for k in keys)

    def go(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                s = stft(np.asarray(row.l, float), n_fft, hop)
                n = s.shape[1]
                yield pd.DataFrame({**{k: [getattr(row, k)] * n for k in keys}, "win_id": row.win_id, "frame": np.arange(n), "re": list(s.real.T), "im": list(s.imag.T)})

    return wins.select(*keys, "win_id", "l").mapInPandas(go, f"{kinds}, win_id int, frame int, re array<double>, im array<double>")
