"""Timed and checked runs: a synthetic track, one run, a resumption that must save work, pairs in both orders.

    python -m wavelane.harness synth OUT.wav [SECONDS]
    python -m wavelane.harness run MODEL IN.wav OUT_DIR
    python -m wavelane.harness resume-check MODEL IN.wav OUT_DIR
    python -m wavelane.harness pair MODEL_A MODEL_B IN.wav OUT_DIR

A model named `scaled` or `scaled:SAMPLES` is a stand-in without a file.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cli import Args, engine_of, summary
from .config import SAMPLE_RATE, CancelFlag, Options, Report
from .errors import EXIT_FAILED, EXIT_OK, EXIT_USAGE, Cancelled, OutputError, SeparationError
from .operators import metrics
from .operators.overlap import ScaledMix
from .plans.grid import Grid
from .sources import stems, wav
from .streaming.track import separate_track


def synthetic(spark: SparkSession, seconds: float) -> DataFrame:
    """pos, l, r: two tones and a hash noise, by position alone."""
    i = F.col("id")
    tone = lambda a, hz: a * F.sin(2 * F.pi() * hz * i / SAMPLE_RATE)
    noise = (F.pmod(i * 1103515245 + 12345, F.lit(1 << 31)) / float(1 << 31) - 0.5) * 0.1
    return spark.range(int(seconds * SAMPLE_RATE)).select(i.alias("pos"), (tone(0.4, 196) + noise).alias("l"), (tone(0.3, 980) + noise).alias("r"))


def synth(spark: SparkSession, path: str, seconds: float = 12.0) -> int:
    return wav.write_track(synthetic(spark, seconds), path, f"{path}.pieces")


def engine(model: str) -> tuple[Callable, Grid, int]:
    name, _, window = model.partition(":")
    if name == "scaled":
        win = int(window or 4 * SAMPLE_RATE)
        return (lambda: ScaledMix(win)), Grid(win, win * 3 // 8), 0
    return engine_of(Args(model, "", ""))


def run(spark: SparkSession, model: str, path: str, folder: str, options: Options | None = None) -> Report:
    make, grid, need = engine(model)
    vocals, background = outputs(folder)
    return separate_track(spark, path, vocals, background, make, grid, model, need, options)


def outputs(folder: str) -> tuple[str, str]:
    return os.path.join(folder, "vocals.wav"), os.path.join(folder, "background.wav")


def resume_check(spark: SparkSession, model: str, path: str, folder: str, rounds: int = 2, at_once: int = 1) -> Report:
    """Stops a run after some rounds and resumes it; raises OutputError unless that saved work and gave the same bytes."""
    whole, cut = os.path.join(folder, "whole"), os.path.join(folder, "cut")
    options = Options(windows_at_once=at_once, resume=False)
    run(spark, model, path, whole, options)
    flag, seen = CancelFlag(), []

    def stop(percent: int, what: str) -> None:
        seen.append(what)
        if len(seen) == rounds + 1:
            flag.cancel()

    stems.discard(*outputs(cut))
    try:
        run(spark, model, path, cut, replace(options, progress=stop, cancel=flag))
        raise OutputError("the run ended before it could be stopped")
    except Cancelled:
        pass
    done = run(spark, model, path, cut, replace(options, resume=True))
    if not done.resumed_from:
        raise OutputError("the second run began at frame 0: nothing was resumed")
    for a, b in zip(outputs(whole), outputs(cut), strict=True):
        if (at := first_difference(a, b)) is not None:
            raise OutputError(f"{b} differs from {a} at byte {at}")
    return done


def first_difference(a: str, b: str, block: int = 1 << 20) -> int | None:
    """The first byte in which two files differ; a file that ends differs there."""
    at = 0
    with open(a, "rb") as f, open(b, "rb") as g:
        while True:
            x, y = f.read(block), g.read(block)
            if x != y:
                return at + next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            if not x:
                return None
            at += len(x)


def pair(spark: SparkSession, runs: dict[str, Callable[[], float]]) -> tuple[DataFrame, DataFrame]:
    """Runs two configurations in either order; (label, order, wall_s) of the four runs, and the paired estimate."""
    a, b = runs
    rows = [(1, label, "".join(order), float(runs[label]())) for order in ((a, b), (b, a)) for label in order]
    rows = [(k, "A" if label == a else "B", "AB" if order == a + b else "BA", s) for k, label, order, s in rows]
    times = spark.createDataFrame(rows, "k int, label string, order string, wall_s double")
    return times.drop("k"), metrics.paired_estimate(times, ["k"])


def main(argv: list[str]) -> int:
    from . import ship

    wants = {"synth": (1, 2), "run": (3, 3), "resume-check": (3, 3), "pair": (4, 4)}
    if not argv or argv[0] not in wants or not wants[argv[0]][0] <= len(argv) - 1 <= wants[argv[0]][1]:
        print(__doc__, file=sys.stderr)
        return EXIT_USAGE
    spark = SparkSession.builder.appName("wavelane-harness").getOrCreate()
    ship(spark)
    what, *rest = argv
    try:
        if what == "synth":
            print(f"{synth(spark, rest[0], *map(float, rest[1:])):,} frames")
        elif what == "run":
            print(summary(run(spark, *rest)))
        elif what == "resume-check":
            print(f"identical; {summary(resume_check(spark, *rest))}")
        else:
            one, two, path, folder = rest
            fresh = Options(resume=False)
            times, estimate = pair(spark, {"A": lambda: run(spark, one, path, folder, fresh).wall_s, "B": lambda: run(spark, two, path, folder, fresh).wall_s})
            print("label\torder\twall_s\n" + "\n".join(f"{r.label}\t{r.order}\t{r.wall_s:.3f}" for r in times.collect()))
            estimate.drop("k").show(truncate=False)
    except SeparationError as e:
        print(f"{e.kind} error: {e}", file=sys.stderr)
        return EXIT_FAILED
    return EXIT_OK


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
