"""Separation as a stream of windows: bounded state, final frames only, exact resuming.

Windows of a track arrive in order, some per micro-batch. The state of a track is
one window of weighted sums; a window makes all frames before the next one's start
final, and these are emitted once. Spark's checkpoint makes a stopped query go on
where it was; the job record beside it says for which input, model and grid it
holds, and another job starts over.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Options
from ..operators.overlap import PARTS, Separator
from ..plans.grid import Grid
from ..sources import files
from ..sources.sidecar import Job

WINDOWS = "track string, win_id int, start long, next_start long, is_first boolean, is_last boolean, l array<float>, r array<float>"
OUTPUT = "track string, pos long, voc_l float, voc_r float, bg_l float, bg_r float"
STATE = "sums array<float>, weights array<float>, upto long"


def stage_windows(wins: DataFrame, folder: str) -> None:
    """One file of rows for each window number, written in their order, so that a trigger takes one at a time.

    Written in one job to a folder a number; the files are then moved beside one
    another, as a stream reads the oldest first and its schema has win_id itself.
    """
    spark = wins.sparkSession
    aside = f"{folder}-staging"
    wins.withColumn("__w", F.col("win_id")).repartition("__w").write.partitionBy("__w").mode("overwrite").parquet(aside)
    files.make_folder(spark, folder)
    for number in sorted(int(name.partition("=")[2]) for name in files.names(spark, aside) if name.startswith("__w=")):
        for name in files.names(spark, f"{aside}/__w={number}"):
            if not name.startswith(("_", ".")):
                files.move(spark, f"{aside}/__w={number}/{name}", f"{folder}/{number:09d}-{name}", stamp=number)
    files.delete(spark, aside)


def separated(stream: DataFrame, make: Callable[[], Separator], grid: Grid) -> DataFrame:
    """Final frames of a stream of windows."""
    ramp = (np.arange(grid.overlap) / max(grid.overlap - 1, 1)).astype(np.float32)
    engines: list[Separator] = []

    def merge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if not engines:
            engines.append(make())
        rows = pd.concat(list(batches)).sort_values("win_id")
        if state.exists:
            flat, w, upto = state.get
            sums, weights = np.array(flat, np.float32).reshape(4, grid.win), np.array(w, np.float32)
        else:
            sums, weights, upto = np.zeros((4, grid.win), np.float32), np.zeros(grid.win, np.float32), 0
        out = []
        for row in rows.itertuples(index=False):
            if row.start < upto:
                raise ValueError(f"window {row.win_id} of {key[0]} starts before frame {upto}, which is final")
            if row.start > upto:
                raise ValueError(f"frames {upto} to {row.start} of {key[0]} have no window")
            n = len(row.l)
            mix = np.zeros((2, grid.win), np.float32)
            mix[0, :n], mix[1, :n] = row.l, row.r
            vocals, background = engines[0].separate(mix)
            fade = np.ones(grid.win, np.float32)
            if not row.is_first and grid.overlap:
                fade[: grid.overlap] = ramp
            if not row.is_last and grid.overlap:
                fade[-grid.overlap :] = ramp[::-1]
            fade[n:] = 0
            sums += np.concatenate([vocals, background]).astype(np.float32) * fade
            weights += fade
            m = int(row.next_start - row.start)
            made = np.where(weights[:m] > 1e-8, sums[:, :m] / np.maximum(weights[:m], 1e-8), 0).astype(np.float32)
            out.append(pd.DataFrame({"track": key[0], "pos": np.arange(row.start, row.next_start), **dict(zip(PARTS, made, strict=True))}))
            rest = grid.win - m
            sums[:, :rest], sums[:, rest:] = sums[:, m:].copy(), 0
            weights[:rest], weights[rest:] = weights[m:].copy(), 0
            upto = int(row.next_start)
        state.update((sums.ravel().tolist(), weights.tolist(), upto))
        yield pd.concat(out)

    return stream.groupBy("track").applyInPandasWithState(merge, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def claim(spark: SparkSession, folder: str, job: Job) -> bool:
    """Whether a checkpoint in folder is this job's; if not, it goes and the folder is claimed."""
    try:
        if Job.decode(files.read_text(spark, f"{folder}/job") or "") == job:
            return True
    except ValueError:
        pass
    discard(spark, folder)
    files.make_folder(spark, folder)
    files.write_text(spark, f"{folder}/job", job.encode())
    return False


def discard(spark: SparkSession, folder: str) -> None:
    """Gives up a checkpoint; nothing else does."""
    files.delete(spark, folder)


def run(spark: SparkSession, windows_dir: str, folder: str, job: Job, make: Callable[[], Separator], grid: Grid, options: Options | None = None, most_batches: int | None = None) -> bool:
    """Separates the staged windows into folder/out; returns whether it resumed.

    Ends when all staged windows are done, or between micro-batches, of one window
    file each, after most_batches of them or when cancelled; the latter raises
    Cancelled. A later call goes on there. No windows give an empty table.
    """
    options = options or Options()
    options.cancel.check()  # before anything is created
    resumed = claim(spark, folder, job) and options.resume
    if not resumed:
        for part in ("checkpoint", "out"):
            discard(spark, f"{folder}/{part}")
    files.make_folder(spark, windows_dir)
    source = spark.readStream.schema(WINDOWS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(windows_dir)
    done = {"batches": 0}
    enough = threading.Event()

    def put(batch: DataFrame, epoch: int) -> None:
        if enough.is_set():  # stopping: this epoch is not committed, and runs again on resuming
            raise InterruptedError("the run ends before this window")
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")
        done["batches"] += 1
        options.report(done["batches"], max(job.n_chunks, 1), "window")
        if options.cancel.is_cancelled() or (most_batches is not None and done["batches"] >= most_batches):
            enough.set()

    query = separated(source, make, grid).writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        _drive(query, enough)
    finally:
        query.stop()
    if not done["batches"] and not files.exists(spark, f"{folder}/out"):
        spark.createDataFrame([], OUTPUT).write.parquet(f"{folder}/out/epoch=0")
    options.cancel.check()
    return resumed


def _drive(query, enough: threading.Event) -> None:
    """Waits until all is done, or until a window is done and no more are wanted."""
    while query.isActive and not enough.is_set():
        try:
            query.awaitTermination(0.05)
        except StreamingQueryException:
            if not enough.is_set():
                raise
    if not enough.is_set() and (e := query.exception()) is not None:
        raise e
