import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane import cli
from wavelane.config import CancelFlag, Options, percent
from wavelane.errors import Cancelled, MemoryRefusal
from wavelane.operators.overlap import PARTS, ScaledMix, stems, windows
from wavelane.plans.grid import Grid
from wavelane.sources.sidecar import Job
from wavelane.streaming import separate as st

GRID = Grid(100, 30)
TOTAL = 1013


def frames(spark):
    x = F.sin(F.col("id") * 0.11)
    return spark.range(TOTAL).select(F.lit("a").alias("track"), F.col("id").alias("pos"), F.lit(TOTAL).cast("long").alias("total"), x.cast("float").alias("l"), (x * 0.5).cast("float").alias("r"))


def staged(spark, folder):
    sched = GRID.schedule(spark.createDataFrame([("a", TOTAL)], "track string, total long"), "total", "track").select("track", "win_id", "next_start")
    wins = windows(frames(spark), GRID, ["track"]).withColumn("win_id", F.col("win_id").cast("int")).join(sched, ["track", "win_id"])
    wins = wins.select("track", "win_id", "start", "next_start", "is_first", "is_last", "l", "r")
    st.stage_windows(wins, folder)
    return wins.count()


def make():
    return ScaledMix(GRID.win)


def result(spark, folder):
    return spark.read.parquet(f"{folder}/out").orderBy("pos").toPandas()


def test_stopped_and_resumed_is_the_whole_run(spark, tmp_path):
    n = staged(spark, f"{tmp_path}/wins")
    job = Job(1, TOTAL, n, 100, 30, 5, 6, 7, 8)
    seen = []
    assert not st.run(spark, f"{tmp_path}/wins", f"{tmp_path}/whole", job, make, GRID, Options(progress=lambda p, m: seen.append(p)))
    whole = result(spark, f"{tmp_path}/whole")
    assert whole.pos.tolist() == list(range(TOTAL)) and seen[-1] == 100 and seen == sorted(seen)
    batch = stems(frames(spark), GRID, make, ["track"]).orderBy("pos").toPandas()
    assert all(np.abs(whole[p] - batch[p]).max() < 1e-6 for p in PARTS)

    assert not st.run(spark, f"{tmp_path}/wins", f"{tmp_path}/cut", job, make, GRID, most_batches=4)
    early = len(glob.glob(f"{tmp_path}/cut/out/epoch=*"))
    assert 4 <= early < n
    assert st.run(spark, f"{tmp_path}/wins", f"{tmp_path}/cut", job, make, GRID)
    again = result(spark, f"{tmp_path}/cut")
    assert all((again[p].to_numpy().view("i4") == whole[p].to_numpy().view("i4")).all() for p in PARTS)

    other = Job(1, TOTAL, n, 100, 30, 5, 6, 7, 9)
    assert not st.claim(spark, f"{tmp_path}/cut", other) and not glob.glob(f"{tmp_path}/cut/out")
    assert st.claim(spark, f"{tmp_path}/cut", other)
    st.discard(spark, f"{tmp_path}/cut")
    assert not glob.glob(f"{tmp_path}/cut")


@pytest.mark.parametrize("total", [0, 80, 100, 150])
def test_as_many_windows_as_there_are(spark, tmp_path, total):
    """Runs end on tracks of none, one and two windows, whatever most_batches says."""
    rows = frames(spark).filter(F.col("pos") < total).withColumn("total", F.lit(total).cast("long"))
    sched = GRID.schedule(spark.createDataFrame([("a", total)] if total else [], "track string, total long"), "total", "track").select("track", "win_id", "next_start")
    wins = windows(rows, GRID, ["track"]).withColumn("win_id", F.col("win_id").cast("int")).join(sched, ["track", "win_id"])
    st.stage_windows(wins.select("track", "win_id", "start", "next_start", "is_first", "is_last", "l", "r"), f"{tmp_path}/wins")
    job = Job(1, total, 2, 100, 30, 5, 6, 7, 8)
    for most in (5, None):
        st.run(spark, f"{tmp_path}/wins", f"{tmp_path}/run", job, make, GRID, most_batches=most)
        assert result(spark, f"{tmp_path}/run").pos.tolist() == list(range(total))


def test_cancelled_during_the_run(spark, tmp_path):
    n = staged(spark, f"{tmp_path}/wins")
    job, flag = Job(1, TOTAL, n, 100, 30, 5, 6, 7, 8), CancelFlag()
    seen = []

    def progress(p, m):
        seen.append(p)
        if len(seen) == 3:
            flag.cancel()

    with pytest.raises(Cancelled):
        st.run(spark, f"{tmp_path}/wins", f"{tmp_path}/run", job, make, GRID, Options(progress=progress).with_cancel(flag))
    assert 3 <= len(glob.glob(f"{tmp_path}/run/out/epoch=*")) < n
    assert st.run(spark, f"{tmp_path}/wins", f"{tmp_path}/run", job, make, GRID)
    assert result(spark, f"{tmp_path}/run").pos.tolist() == list(range(TOTAL))


def test_cancelled_before_it_starts_makes_nothing(spark, tmp_path):
    flag = CancelFlag()
    flag.cancel()
    with pytest.raises(Cancelled):
        st.run(spark, f"{tmp_path}/w", f"{tmp_path}/x", Job(1, 1, 1, 1, 0, 0, 0, 0, 0), make, GRID, Options().with_cancel(flag))
    assert not glob.glob(f"{tmp_path}/x")


def test_options():
    o = Options().with_memory_budget_mb(5).with_progress(print)
    assert o.memory_budget_mb == 5 and o.progress is print and Options().memory_budget_mb is None
    assert [percent(a, b) for a, b in ((0, 0), (1, 3), (5, 3), (2, 3))] == [100, 33, 100, 66]


def test_command_lines():
    a = cli.parse(["--model", "m.onnx", "--out", "o", "song.wav"])
    assert (a.model, a.out_dir, a.input, a.engine, a.window, a.threads, a.fresh, a.quiet) == ("m.onnx", "o", "song.wav", "auto", None, 4, False, False)
    b = cli.parse(["x.wav", "-q", "--window=4s", "--fresh", "-t", "2", "-m", "m", "-o", "o"])
    assert (b.window, b.threads, b.fresh, b.quiet) == (176_400, 2, True, True)
    assert cli.parse(["-h"]) == "help" and cli.parse(["--version"]) == "version"
    assert cli.choose_engine(a) == "onnx" and cli.choose_engine(cli.Args("m.safetensors", "i", "o")) == "network"
    for bad in (["x.wav"], ["--model", "m", "--out", "o"], ["--model", "m", "--out", "o", "a", "b"], ["--what"], ["--threads", "0"], ["--threads", "x"], ["--window", "--fresh"], ["--fresh=1"], ["--engine", "z"], ["--window", "1e9s"], ["--window", "0s"], ["--window", "."]):
        with pytest.raises(cli.UsageError):
            cli.parse(bad)
    assert cli.main(["--nope"]) == 2 and cli.main(["-V"]) == 0
    assert "hint" in cli.explain(MemoryRefusal(5, 4)) and cli.group_digits(1234567) == "1,234,567"
