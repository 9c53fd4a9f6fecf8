"""Windows through a separator and back by weighted overlap-add.

A separator takes the windows of a track and gives vocals and background for
each. Windows are keyed by (track, win_id), so they spread over the cluster; the
crossfaded parts meet again by position.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grid import Grid, every_position

PARTS = ("voc_l", "voc_r", "bg_l", "bg_r")


class Separator(Protocol):
    """One engine: what it is called, its window and rate, and how it separates."""

    name: str
    window_samples: int
    sample_rate: int

    def separate(self, mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(2, window) in; vocals and background of that shape out."""


class ScaledMix:
    """A stand-in model: vocals are a fixed share of the mix, background is the rest."""

    name, sample_rate = "scaled", 44_100

    def __init__(self, window_samples: int, share: float = 0.25, dtype=np.float32):
        self.window_samples, self.share, self.dtype = window_samples, share, dtype

    def separate(self, mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vocals = mix * self.share
        return vocals, mix - vocals


def crossfade(parts: DataFrame, keys: list[str], floor: float = 1e-8) -> DataFrame:
    """keys and the four parts: sum of part times w over sum of w; silence where w sums to nothing.

    parts: keys, voc_l, voc_r, bg_l, bg_r, w.
    """
    sums = parts.groupBy(*keys).agg(F.sum("w").alias("w_sum"), *[F.sum(F.col(p) * F.col("w")).alias(p) for p in PARTS])
    return sums.select(*keys, "w_sum", *[F.when(F.col("w_sum") > floor, F.col(p) / F.col("w_sum")).otherwise(F.lit(0.0)).alias(p) for p in PARTS])


def stems_by_row(frames: DataFrame, grid: Grid, vocals: Callable[[Column], Column], keys: list[str]) -> DataFrame:
    """For separators that are a column expression: all in the JVM.

    frames: keys, pos, total, l, r.
    """
    rows = grid.assign(frames)
    return crossfade(
        rows.select(
            *keys, "pos",
            *[f(F.col(c)).alias(f"{p}_{c}") for p, f in (("voc", vocals), ("bg", lambda x: x - vocals(x))) for c in ("l", "r")],
            grid.fade(F.col("k"), F.col("is_first"), F.col("is_last")).alias("w"),
        ),
        [*keys, "pos"],
    )


def windows(frames: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """One row a window: keys, win_id, start, is_first, is_last, l, r (arrays, in order)."""
    rows = grid.assign(frames).groupBy(*keys, "win_id", "start", "is_first", "is_last").agg(F.array_sort(F.collect_list(F.struct("k", "l", "r"))).alias("f"))
    return rows.select(*keys, "win_id", "start", "is_first", "is_last", F.col("f.l").alias("l"), F.col("f.r").alias("r"))


def separate_windows(wins: DataFrame, make: Callable[[], Separator], grid: Grid, keys: list[str]) -> DataFrame:
    """keys, pos, w and the four parts of each frame of each window; one separator a Python worker."""
    kinds = ", ".join(f"`{k}` {wins.schema[k].dataType.simpleString()}" for k in keys)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        engine = make()
        ramp = np.arange(grid.overlap) / max(grid.overlap - 1, 1)
        for batch in batches:
            for row in batch.itertuples(index=False):
                n = len(row.l)
                mix = np.zeros((2, grid.win), getattr(engine, "dtype", np.float32))
                mix[0, :n], mix[1, :n] = row.l, row.r
                vocals, background = engine.separate(mix)
                w = np.ones(grid.win)
                if not row.is_first:
                    w[: grid.overlap] = ramp
                if not row.is_last:
                    w[grid.win - grid.overlap :] = ramp[::-1]
                out = {k: [getattr(row, k)] * n for k in keys}
                out |= {"pos": np.arange(row.start, row.start + n), "w": w[:n]}
                out |= {p: x[:n].astype(float) for p, x in zip(PARTS, (*vocals, *background), strict=True)}
                yield pd.DataFrame(out)

    return wins.mapInPandas(go, f"{kinds}, pos long, w double, voc_l double, voc_r double, bg_l double, bg_r double")


def stems(frames: DataFrame, grid: Grid, make: Callable[[], Separator], keys: list[str]) -> DataFrame:
    return crossfade(separate_windows(windows(frames, grid, keys), make, grid, keys), [*keys, "pos"])


def ordered_sum(parts: DataFrame, keys: list[str], value: str = "c", order: str = "win_id") -> DataFrame:
    """keys and the sum in single precision, added in order: bit for bit that of a sequential loop."""
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("float").alias("c")))).alias("xs"))
    return rows.select(*keys, F.aggregate("xs", F.lit(0).cast("float"), lambda a, x: (a + x["c"]).cast("float")).alias("sum"))


def filled(out: DataFrame, tracks: DataFrame, keys: list[str], columns: tuple[str, ...] = PARTS) -> DataFrame:
    """out with silence at positions of tracks (keys, total) that it lacks."""
    every = every_position(tracks.select(*keys, "total"), F.col("total")).drop("total")
    return every.join(out, [*keys, "pos"], "left").select(*keys, "pos", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in columns])


def running(rows: DataFrame, keys: list[str], order: str, value: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
