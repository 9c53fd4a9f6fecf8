"""One WAV track into two stems: windows side by side, frames final in order, resumed exactly.

Windows of a track run in rounds, as many at once as the cluster has cores. Each is
read, separated and faded where it runs and gives its part of every segment it
covers; a segment reaches from one window's start to the next one's. Segments before
the first window of the next round are final: their parts are added in window order,
in single precision, so neither the rounds nor a stop and a resumption change a bit.
Parts of later segments wait in the shared folder. After each round the staged stems
are a checkpoint.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SAMPLE_RATE, Options, Report
from ..errors import OutputError
from ..operators.admission import admit, peak_mb
from ..operators.overlap import Separator
from ..plans.grid import Grid
from ..sources import files, wav
from ..sources.sidecar import Job
from ..sources.stems import StemPair

WINDOWS = "win_id int, start long, take int, is_first boolean, is_last boolean, segments array<struct<id: int, first: long, after: long>>"
PARTS = "segment int, win_id int, n int, at int, sums binary, weights binary"
FINAL = "segment int, vocals binary, background binary"


def _faded(wins: DataFrame, path: str, head: wav.Header, grid: Grid, make: Callable[[], Separator]) -> DataFrame:
    """Each window's faded part of each segment that isn't final yet."""

    def go(batches):
        engine = make()
        ramp = (np.arange(grid.overlap) / max(grid.overlap - 1, 1)).astype(np.float32)
        for batch in batches:
            for row in batch.itertuples(index=False):
                mix = np.zeros((2, grid.win), np.float32)
                mix[:, : row.take] = wav.read_stereo(path, head, row.start, row.take).T
                out = np.concatenate([np.asarray(x, np.float32) for x in engine.separate(mix)])
                fade = np.ones(grid.win, np.float32)
                if not row.is_first and grid.overlap:
                    fade[: grid.overlap] = ramp
                if not row.is_last and grid.overlap:
                    fade[-grid.overlap :] = ramp[::-1]
                rows = []
                for s in row.segments:
                    a, b = max(s["first"], row.start), min(s["after"], row.start + row.take)
                    if a < b:
                        x = slice(a - row.start, b - row.start)
                        rows.append((s["id"], row.win_id, s["after"] - s["first"], a - s["first"], (out[:, x] * fade[x]).tobytes(), fade[x].tobytes()))
                yield pd.DataFrame(rows, columns=["segment", "win_id", "n", "at", "sums", "weights"])

    return wins.mapInPandas(go, PARTS)


def _final(parts: DataFrame) -> DataFrame:
    """Samples of each segment, its parts added in window order."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf.n.iloc[0])
        sums, weights = np.zeros((4, n), np.float32), np.zeros(n, np.float32)
        for row in pdf.sort_values("win_id").itertuples(index=False):
            w = np.frombuffer(row.weights, np.float32)
            x = slice(row.at, row.at + len(w))
            sums[:, x] += np.frombuffer(row.sums, np.float32).reshape(4, -1)
            weights[x] += w
        made = np.where(weights > 1e-8, sums / np.maximum(weights, 1e-8), 0).astype(np.float32)
        raw = [wav.quantise(made[k : k + 2].T.astype(np.float64)).tobytes() for k in (0, 2)]
        return pd.DataFrame({"segment": [int(pdf.segment.iloc[0])], "vocals": raw[:1], "background": raw[1:]})

    return parts.groupBy("segment").applyInPandas(add, FINAL)


def separate_track(spark: SparkSession, path: str, vocals: str, background: str, make: Callable[[], Separator], grid: Grid, model_path: str, need_mb: int = 0, options: Options | None = None) -> Report:
    """Separates the track at path; raises Cancelled between rounds, which keeps what is staged.

    path must be readable where windows run; make gives an engine there.
    """
    options = options or Options()
    options.cancel.check()  # before anything is made
    admit(need_mb, options.memory_budget_mb)
    began, head = time.time(), wav.read_header(path)
    total = wav.track_length(head)
    rows = grid.schedule(spark.createDataFrame([(total,)], "total long")).orderBy("win_id").collect()  # as many as the track has windows
    n = len(rows)
    job = Job.of(total, n, grid.win, grid.overlap, path, model_path)
    segment = [(k, r.start, r.next_start) for k, r in enumerate(rows)]
    folder, waiting = files.shared_folder(spark, "track"), []
    at_once = options.windows_at_once or spark.sparkContext.defaultParallelism
    with peak_mb() as peak, (StemPair.resumed if options.resume else StemPair.fresh)(vocals, background, job) as pair:
        plan = spark.range(1).select(grid.resume(F.lit(total).cast("long"), F.lit(pair.frames).cast("long")).alias("p")).first().p
        pair.rewind(plan.keep_frames)
        try:
            low = plan.prime_from
            while low < n:
                options.cancel.check()
                options.report(pair.frames, total, f"window {low + 1} of {n}")
                after = min(max(low, plan.first) + at_once, n)
                made = []
                for r in rows[low:after]:
                    end = r.start + r["take"]
                    made.append((r.win_id, r.start, r["take"], r.is_first, r.is_last, [s for s in segment[max(r.win_id, plan.first) :][:4] if s[1] < end]))
                wins = spark.createDataFrame(made, WINDOWS).repartition(len(made), "win_id")
                _faded(wins, path, head, grid, make).write.parquet(f"{folder}/from-{low}")  # separated once
                waiting.append(f"{folder}/from-{low}")
                parts = spark.read.schema(PARTS).parquet(*waiting)
                for row in _final(parts.filter((F.col("segment") >= max(low, plan.first)) & (F.col("segment") < after))).orderBy("segment").toLocalIterator():
                    pair.append(row.vocals, row.background)
                pair.checkpoint()
                # A window covers three segments after its own at most, so parts of older rounds are spent.
                while len(waiting) > 1 and int(waiting[1].rpartition("-")[2]) <= after - 4:
                    files.delete(spark, waiting.pop(0))
                low = after
        finally:
            files.delete(spark, folder)
        if pair.frames != total:
            raise OutputError(f"{pair.frames} of {total} frames were written")
        options.report(total, total, "publishing")
        pair.publish()
    return Report(SAMPLE_RATE, total, n - plan.prime_from, plan.prime_from, plan.keep_frames, peak.mb, time.time() - began)
