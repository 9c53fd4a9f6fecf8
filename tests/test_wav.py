import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelane.errors import OutputError, WavError
from wavelane.operators.resample import resample, resample_tracks
from wavelane.sources import wav


def write(path, x, rate, depth):
    """x: (frames, channels) within 1."""
    form, bits = {"i16": (1, 16), "i24": (1, 24), "i32": (1, 32), "f32": (3, 32)}[depth]
    if depth == "f32":
        raw = x.astype("<f4").tobytes()
    else:
        full = (x * (2 ** (bits - 1) - 1)).astype(np.int64)
        raw = b"".join(int(v).to_bytes(bits // 8, "little", signed=True) for v in full.ravel())
    n = x.shape[1]
    head = struct.pack("<HHIIHH", form, n, rate, rate * n * bits // 8, n * bits // 8, bits)
    body = b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(raw)) + raw
    with open(path, "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", len(body)) + body)


def signal(frames, channels):
    f, c = np.arange(frames)[:, None], np.arange(channels)[None, :]
    return np.clip(np.sin(f * 0.37 + c * 1.13) * 0.45 + np.cos(f * 0.0113 - c * 0.7) * 0.45, -0.95, 0.95)


@pytest.mark.parametrize("depth", ["i16", "i24", "i32", "f32"])
@pytest.mark.parametrize("channels", [1, 2, 3, 6])
def test_depths_and_folds(spark, tmp_path, depth, channels):
    x, path = signal(901, channels), str(tmp_path / "a.wav")
    write(path, x, 44100, depth)
    got = wav.read_track(spark, path, frames_per_partition=200).orderBy("pos").toPandas()
    want = np.repeat(x, 2, axis=1) if channels == 1 else np.stack([x[:, 0::2].mean(1), x[:, 1::2].mean(1)], 1)
    assert got.pos.tolist() == list(range(901))
    assert np.abs(got[["l", "r"]].to_numpy() - want).max() < (1e-4 if depth == "i16" else 1e-6)


def test_ranges_and_errors(spark, tmp_path):
    path = str(tmp_path / "a.wav")
    write(path, signal(100, 2), 48000, "i16")
    assert [r.pos for r in wav.read_track(spark, path, first=40, take=7).orderBy("pos").collect()] == list(range(40, 47))
    with pytest.raises(Exception, match="but there are 100"):
        wav.read_track(spark, path, first=95, take=6).count()
    assert wav.track_length(wav.read_header(path)) == 92
    with open(path, "r+b") as f:
        f.truncate(os.path.getsize(path) - 10)
    with pytest.raises(WavError, match="frame 97"):
        wav.read_header(path)
    with pytest.raises(WavError, match="no WAV"):
        (tmp_path / "b").write_bytes(b"hello, this is text")
        wav.read_header(str(tmp_path / "b"))
    for form, bits in ((1, 8), (3, 64)):
        with pytest.raises(WavError):
            wav.depth_of(form, bits)


def test_write_and_read_back(spark, tmp_path):
    x = signal(5000, 2)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "pos long, l double, r double")
    path = str(tmp_path / "out.wav")
    assert wav.write_track(df, path, str(tmp_path / "pieces"), per=1024) == 5000
    raw = open(path, "rb").read()
    assert raw[:44] == wav.header_bytes(20000) and len(raw) == 20044
    assert np.array_equal(np.frombuffer(raw[44:], "<i2").reshape(-1, 2), np.trunc(x * 32767).astype(np.int16))
    assert not os.path.exists(path + ".part")
    with pytest.raises(Exception, match="frame 0 is missing"):
        wav.write_track(df.filter("pos > 2000"), path, str(tmp_path / "pieces"), per=1024)
    with pytest.raises(OutputError):
        wav.header_bytes(1 << 32)


def test_mono_blocks_agree(tmp_path):
    path = str(tmp_path / "m.wav")
    write(path, signal(9001, 3), 44100, "f32")
    a, b = wav.read_mono(path, 44100), wav.read_mono(path, 44100, block=1000)
    assert np.array_equal(a, b) and len(a) == 9001
    c, d = wav.read_mono(path, 16000), wav.read_mono(path, 16000, block=777)
    assert len(c) == len(d) == -(-9001 * 16000 // 44100) and np.allclose(c, d, atol=1e-6)

    def stop(_):
        raise RuntimeError("enough")

    with pytest.raises(RuntimeError):
        wav.stream_mono(path, stop)


def test_resampling_keeps_a_tone(spark):
    x = np.sin(np.arange(20000) * 0.05) * 0.5
    y = resample(x, 44100, 16000)
    t = np.arange(len(y)) * 44100 / 16000
    assert np.abs(y - np.sin(t * 0.05) * 0.5)[200:-200].max() < 2e-3
    assert np.array_equal(resample(x, 8000, 8000), x.astype(np.float32))
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "t string, pos long, v double")
    got = resample_tracks(df, ["t"], 44100, 16000, block=4000).orderBy("pos").toPandas()
    assert got.pos.tolist() == list(range(len(y)))
    assert np.abs(got.v.to_numpy() - y).max() < 1e-6
    assert resample_tracks(df, ["t"], 5, 5).agg(F.count("*")).first()[0] == 20000
