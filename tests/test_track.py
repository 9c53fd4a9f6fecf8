"""Whole tracks: staged, stopped, resumed, published; the command line and the harness."""

import os
import struct

import numpy as np
import pytest

from wavelane import cli, harness
from wavelane.config import CancelFlag, Options
from wavelane.errors import Cancelled, InputError, MemoryRefusal, OutputError, WavError
from wavelane.operators.admission import network_need_mb, onnx_need_mb
from wavelane.operators.overlap import ScaledMix
from wavelane.plans.grid import Grid
from wavelane.sources import stems, wav
from wavelane.sources.sidecar import Job
from wavelane.streaming.track import separate_track

JOB = Job(1, 100, 3, 40, 10, 1, 2, 3, 4)


def raw(n, k=1):
    return struct.pack(f"<{2 * n}h", *[k * x % 3000 for x in range(2 * n)])


def paths(folder):
    return f"{folder}/out/vocals.wav", f"{folder}/out/background.wav"


def test_pair_is_written_resumed_and_published(tmp_path):
    v, b = paths(tmp_path)
    with stems.StemPair.resumed(v, b, JOB) as pair:
        assert pair.frames == 0 and "sidecar" in pair.why
        pair.append(raw(30), raw(30, 2))
        pair.checkpoint()
        pair.append(raw(7), raw(7, 2))
    # Left without publishing, the headers state all that was written.
    assert wav.read_header(stems.part(v)).frames == wav.read_header(stems.part(b)).frames == 37
    with stems.StemPair.resumed(v, b, JOB) as pair:
        assert (pair.frames, pair.why) == (37, "")
        with pytest.raises(WavError):
            pair.rewind(38)
        pair.rewind(30)
        assert os.path.getsize(stems.part(v)) == 44 + 30 * 4
        with pytest.raises(OutputError):
            pair.append(raw(2), raw(1))
        pair.append(raw(5), raw(5))
        pair.publish()
    assert wav.read_header(v).frames == wav.read_header(b).frames == 35 and sorted(os.listdir(f"{tmp_path}/out")) == ["background.wav", "vocals.wav"]
    with open(v, "rb") as f:
        assert f.read()[44:] == raw(30) + raw(5)


def test_doubts_start_over(tmp_path):
    v, b = paths(tmp_path)

    def staged():
        with stems.StemPair.fresh(v, b, JOB) as pair:
            pair.append(raw(30), raw(30))

    def frames(job=JOB):
        with stems.StemPair.resumed(v, b, job) as pair:
            return pair.frames

    staged()
    assert frames() == 30
    assert frames(Job(1, 100, 3, 40, 10, 1, 2, 3, 5)) == 0
    staged()
    with open(stems.part(b), "r+b") as f:  # a torn stem: the shorter of both counts
        f.truncate(44 + 4 * 11 + 3)
    assert frames() == 11
    for harm in (lambda: os.remove(stems.part(b)), lambda: os.remove(stems.sidecar(v)), lambda: open(stems.part(v), "wb").close(), lambda: open(stems.sidecar(v), "w").write("format=1\nformat=1\n")):
        staged()
        harm()
        assert frames() == 0
    staged()
    with stems.StemPair.fresh(v, b) as pair:  # a run that can't be resumed leaves no sidecar
        assert pair.frames == 0
    assert not os.path.exists(stems.sidecar(v))
    staged()
    stems.discard(v, b)
    assert os.listdir(f"{tmp_path}/out") == []


def test_both_stems_or_none(tmp_path):
    v, b = paths(tmp_path)
    pair = stems.StemPair.fresh(v, b, JOB)
    pair.append(raw(3), raw(3))
    os.makedirs(f"{v}/occupied")  # the vocals can't be put in place
    with pytest.raises(InputError):
        pair.publish()
    assert not os.path.exists(b) and os.listdir(f"{tmp_path}/out") == ["vocals.wav"]


def track(path, n, rate=44_100, seed=0):
    x = (np.random.default_rng(seed).normal(0, 4000, (n, 2))).clip(-32768, 32767).astype("<i2")
    with open(path, "wb") as f:
        f.write(wav.header_bytes(n * 4, rate) + x.tobytes())
    return x / 32768.0


GRID = Grid(400, 150)


def separated(spark, folder, path, name, **options):
    out = [f"{folder}/{name}/{s}.wav" for s in ("vocals", "background")]
    report = separate_track(spark, path, *out, lambda: ScaledMix(GRID.win), GRID, "model", options=Options(**options))
    return report, [open(p, "rb").read() for p in out]


@pytest.mark.parametrize("total", [0, 1, 399, 400, 401, 2345])
def test_tracks_of_any_length(spark, tmp_path, total):
    x = track(f"{tmp_path}/in.wav", total)
    report, (v, b) = separated(spark, tmp_path, f"{tmp_path}/in.wav", "whole")
    assert report.frames == total == (len(v) - 44) // 4 and report.resumed_from == 0 and (not total or report.windows_resumed == 0)
    got = np.frombuffer(v[44:], "<i2").reshape(-1, 2)
    assert not total or np.abs(got - np.trunc(x * 0.25 * 32767)).max() <= 1


def test_stopped_anywhere_and_resumed_is_the_whole_run(spark, tmp_path):
    track(f"{tmp_path}/in.wav", 2345)
    path = f"{tmp_path}/in.wav"
    _, whole = separated(spark, tmp_path, path, "whole", windows_at_once=4)
    for name, at_once, stop in (("a", 1, 3), ("b", 3, 1), ("c", 2, 3)):
        flag, seen = CancelFlag(), []

        def progress(percent, what):
            seen.append(percent)
            if len(seen) > stop:
                flag.cancel()

        with pytest.raises(Cancelled):
            separated(spark, tmp_path, path, name, windows_at_once=at_once, progress=progress, cancel=flag)
        report, again = separated(spark, tmp_path, path, name, windows_at_once=2)
        assert again == whole and report.resumed_from > 0 and seen == sorted(seen)
        assert report.windows_inferred + report.windows_resumed == 9 and report.windows_inferred < 9
    fresh, again = separated(spark, tmp_path, path, "a", resume=False)
    assert fresh.resumed_from == 0 and again == whole


def test_gate_and_flag_come_before_any_file(spark, tmp_path):
    track(f"{tmp_path}/in.wav", 500)
    flag = CancelFlag()
    flag.cancel()
    with pytest.raises(Cancelled):
        separated(spark, tmp_path, f"{tmp_path}/in.wav", "x", cancel=flag)
    with pytest.raises(MemoryRefusal):
        separate_track(spark, f"{tmp_path}/in.wav", *paths(tmp_path), lambda: ScaledMix(400), GRID, "model", need_mb=11, options=Options(memory_budget_mb=10))
    assert os.listdir(tmp_path) == ["in.wav"]
    assert onnx_need_mb(352_800) == 19_400 and onnx_need_mb(176_400) == 5_100 and 2_800 < network_need_mb(352_800) < 3_200


def test_other_rates_are_read_in_windows(tmp_path):
    x = track(f"{tmp_path}/in.wav", 1000, rate=48_000)
    h = wav.read_header(f"{tmp_path}/in.wav")
    n = wav.track_length(h)
    p = np.arange(n) * 999 / (n - 1)
    want = np.stack([np.interp(p, np.arange(1000), x[:, c]) for c in (0, 1)], axis=1)
    got = np.concatenate([wav.read_stereo(f"{tmp_path}/in.wav", h, a, min(100, n - a)) for a in range(0, n, 100)])
    assert n == 919 and np.abs(got - want).max() < 1e-6
    with pytest.raises(WavError):
        wav.read_stereo(f"{tmp_path}/in.wav", h, n - 1, 2)


def test_harness(spark, tmp_path, capsys):
    assert harness.synth(spark, f"{tmp_path}/s.wav", 0.05) == 2205
    report = harness.resume_check(spark, "scaled:400", f"{tmp_path}/s.wav", f"{tmp_path}/check")
    assert report.resumed_from > 0
    with pytest.raises(OutputError):  # one round does it all, so there is nothing to stop
        harness.resume_check(spark, "scaled:400", f"{tmp_path}/s.wav", f"{tmp_path}/check", rounds=1, at_once=50)
    walls = iter([5.0, 9.0, 8.0, 6.0])
    times, estimate = harness.pair(spark, {"A": lambda: next(walls), "B": lambda: next(walls)})
    assert [tuple(r) for r in times.collect()] == [("A", "AB", 5.0), ("B", "AB", 9.0), ("B", "BA", 8.0), ("A", "BA", 6.0)] and estimate.first().dd == 3.0
    assert harness.main([]) == 2 and harness.main(["run", "x"]) == 2 and harness.main(["run", "none.onnx", "a", "b"]) == 1


def test_command_line_resumes(spark, tmp_path, monkeypatch, capsys):
    track(f"{tmp_path}/in.wav", 1500)
    open(f"{tmp_path}/m.onnx", "wb").close()
    monkeypatch.setattr(cli, "engine_of", lambda args: (lambda: ScaledMix(400), GRID, 0))
    args = ["-m", f"{tmp_path}/m.onnx", "-o", f"{tmp_path}/out", f"{tmp_path}/in.wav"]
    assert cli.main(args) == 0
    whole = [open(p, "rb").read() for p in paths(tmp_path)]
    assert "windows inferred, 0 skipped" in capsys.readouterr().out
    flag, seen = CancelFlag(), []
    stop = Options(windows_at_once=1, cancel=flag, progress=lambda p, w: (seen.append(p), len(seen) > 3 and flag.cancel()))
    with pytest.raises(Cancelled):
        cli.separate_file(spark, cli.parse(args), stop)
    assert cli.main([*args, "-q"]) == 0 and [open(p, "rb").read() for p in paths(tmp_path)] == whole
    with pytest.raises(Cancelled):
        flag._event.clear()
        seen.clear()
        cli.separate_file(spark, cli.parse(args), stop)
    assert cli.main(args) == 0 and "frames kept" in capsys.readouterr().out
    flag._event.clear()
    seen.clear()
    with pytest.raises(Cancelled):
        cli.separate_file(spark, cli.parse(args), stop)
    assert cli.main([*args, "--fresh"]) == 0 and "0 skipped, peak" in capsys.readouterr().out
    assert cli.main(["-m", "none.onnx", "-o", "o", "none.wav"]) == 1
