"""WAV tracks as a Spark data source: read by frame ranges, written as 16-bit stems.

Reading: `spark.read.format("wavelane_wav").option("path", p).load()` gives pos, l,
r (single precision, folded to stereo); options `frames_per_partition`, `first` and
`take` bound what is decoded. Only the header is read to plan; each partition
seeks to its own frames.

Writing: rows pos, l, r go through `write_track`, which sorts them into frame
ranges, has each range encoded where it lies and joins the pieces behind one
header.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import SAMPLE_RATE
from ..errors import InputError, OutputError, WavError

READ_FRAMES = 65_536
HEADER = 44
#: Payload a RIFF size field can state.
MOST_BYTES = (1 << 32) - 1 - 36


@dataclass(frozen=True)
class Header:
    channels: int
    rate: int
    depth: str
    frames: int
    data_at: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * {"i16": 2, "i24": 3, "i32": 4, "f32": 4}[self.depth]


def depth_of(form: int, bits: int) -> str:
    kinds = {(1, 16): "i16", (1, 24): "i24", (1, 32): "i32", (3, 32): "f32"}
    if (form, bits) not in kinds:
        raise WavError(f"{bits}-bit samples of format {form} aren't supported (16-, 24-, 32-bit integers and 32-bit floats are)")
    return kinds[form, bits]


def read_header(path: str, torn: bool = False) -> Header:
    """Walks the chunks up to the data; validates what it finds. A torn file may hold less than its header says."""
    try:
        size = os.path.getsize(path)
        with open(path, "rb") as f:
            riff = f.read(12)
            if len(riff) < 12 or riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
                raise WavError(f"{path}: no WAV file")
            fmt = None
            while True:
                head = f.read(8)
                if len(head) < 8:
                    raise WavError(f"{path}: no data chunk")
                name, n = head[:4], struct.unpack("<I", head[4:])[0]
                if name == b"fmt ":
                    raw = f.read(n + n % 2)
                    form, channels, rate, _, _, bits = struct.unpack("<HHIIHH", raw[:16])
                    if form == 0xFFFE and len(raw) >= 26:  # extensible: the format leads its identifier
                        form = struct.unpack("<H", raw[24:26])[0]
                    fmt = (form, channels, rate, bits)
                elif name == b"data":
                    break
                else:
                    f.seek(n + n % 2, 1)
            at = f.tell()
    except OSError as e:
        raise InputError(f"{path}: {e}") from e
    if fmt is None:
        raise WavError(f"{path}: no format before the data")
    form, channels, rate, bits = fmt
    if channels == 0:
        raise WavError(f"{path}: zero channels")
    if rate == 0:
        raise WavError(f"{path}: sample rate is 0 Hz")
    depth = depth_of(form, bits)
    whole = Header(channels, rate, depth, 0, at).frame_bytes
    if n > size - at and not torn:
        raise WavError(f"{path}: the data ends early, at frame {(size - at) // whole} of {n // whole}")
    return Header(channels, rate, depth, n // whole, at)


def decode(raw: bytes, depth: str, channels: int) -> np.ndarray:
    """(frames, channels) in single precision."""
    if depth == "i24":
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / np.float32(8388608)
    elif depth == "f32":
        x = np.frombuffer(raw, "<f4")
    else:
        x = np.frombuffer(raw, "<i2" if depth == "i16" else "<i4") / np.float32(32768 if depth == "i16" else 2147483648)
    return x.astype(np.float32).reshape(-1, channels)


def fold(frames: np.ndarray) -> np.ndarray:
    """(frames, 2): one channel doubled, two kept, more averaged by even and odd."""
    if frames.shape[1] <= 2:
        return np.repeat(frames, 2, axis=1) if frames.shape[1] == 1 else frames
    return np.stack([frames[:, k::2].mean(axis=1, dtype=np.float32) for k in (0, 1)], axis=1)


def read_frames(path: str, h: Header, first: int, take: int) -> np.ndarray:
    """(take, channels); past the end is an error."""
    if first < 0 or first + take > h.frames:
        raise WavError(f"{path}: {take} frames at {first}, but there are {h.frames}")
    with open(path, "rb") as f:
        f.seek(h.data_at + first * h.frame_bytes)
        raw = f.read(take * h.frame_bytes)
    if len(raw) < take * h.frame_bytes:
        raise WavError(f"{path}: the data ends at frame {first + len(raw) // h.frame_bytes}")
    return decode(raw, h.depth, h.channels)


def read_stereo(path: str, h: Header, first: int, take: int, rate: int = SAMPLE_RATE) -> np.ndarray:
    """(take, 2) of the track at the library's rate; another rate is resampled linearly, from the frames that takes."""
    target = track_length(h, rate)
    if first < 0 or first + take > target:
        raise WavError(f"{path}: {take} frames at {first}, but there are {target}")
    if h.rate == rate or not take:
        return fold(read_frames(path, h, first, take))
    p = np.arange(first, first + take) * (h.frames - 1) / max(target - 1, 1)
    a = np.minimum(np.floor(p).astype(np.int64), h.frames - 1)
    b = np.minimum(a + 1, h.frames - 1)
    x = fold(read_frames(path, h, int(a[0]), int(b[-1] - a[0]) + 1))
    frac = (p - np.floor(p))[:, None]
    return (x[a - a[0]] + frac * (x[b - a[0]] - x[a - a[0]])).astype(np.float32)


def stream_mono(path: str, sink: Callable[[np.ndarray], None], block: int = READ_FRAMES) -> Header:
    """Blocks of the mono fold go to sink in order; its error ends the scan."""
    h = read_header(path)
    for first in range(0, h.frames, block):
        x = read_frames(path, h, first, min(block, h.frames - first))
        sink((x[:, 0] + x[:, 1]) * np.float32(0.5) if h.channels == 2 else x.mean(axis=1, dtype=np.float32))
    return h


def read_mono(path: str, rate: int, block: int = READ_FRAMES) -> np.ndarray:
    """The whole track in one channel at a rate; resampled block by block if it has another."""
    from ..operators.resample import StreamingSinc

    h, out, sinc = read_header(path), [], None
    if h.rate != rate:
        sinc = StreamingSinc(h.rate, rate)
    stream_mono(path, lambda x: out.append(sinc.push(x) if sinc else x), block)
    if sinc:
        out.append(sinc.finish())
    return np.concatenate(out) if out else np.zeros(0, np.float32)


class Frames(InputPartition):
    def __init__(self, path: str, header: Header, first: int, take: int):
        super().__init__((path, first))
        self.path, self.header, self.first, self.take = path, header, first, take


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.header = read_header(self.path)
        self.per = int(options.get("frames_per_partition", 1 << 20))
        self.first = int(options.get("first", 0))
        self.take = int(options.get("take", self.header.frames - self.first))
        if self.first < 0 or self.take < 0 or self.first + self.take > self.header.frames:
            raise WavError(f"{self.path}: {self.take} frames at {self.first}, but there are {self.header.frames}")

    def partitions(self) -> list[Frames]:
        end = self.first + self.take
        return [Frames(self.path, self.header, a, min(self.per, end - a)) for a in range(self.first, end, self.per)] or [Frames(self.path, self.header, 0, 0)]

    def read(self, part: Frames) -> Iterator:
        import pyarrow as pa

        for a in range(part.first, part.first + part.take, READ_FRAMES):
            n = min(READ_FRAMES, part.first + part.take - a)
            x = fold(read_frames(part.path, part.header, a, n))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), pa.array(np.ascontiguousarray(x[:, 0])), pa.array(np.ascontiguousarray(x[:, 1]))], names=["pos", "l", "r"])


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wavelane_wav"

    def schema(self) -> str:
        return "pos long, l float, r float"

    def reader(self, schema) -> WavReader:
        return WavReader(self.options)


def read_track(spark: SparkSession, path: str, **options) -> DataFrame:
    """pos, l, r of a WAV file at its own rate."""
    spark.dataSource.register(WavSource)
    return spark.read.format("wavelane_wav").options(path=path, **options).load()


def track_length(h: Header, rate: int = SAMPLE_RATE) -> int:
    """Frames of the track at the given rate."""
    return int(np.floor(h.frames * rate / h.rate + 0.5))


def header_bytes(data_bytes: int, rate: int = SAMPLE_RATE) -> bytes:
    """The header of 16-bit stereo with so many bytes of samples."""
    if data_bytes > MOST_BYTES:
        raise OutputError("a stem of more than 4 GiB can't be a WAV file")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", data_bytes + 36, b"WAVE", b"fmt ", 16, 1, 2, rate, rate * 4, 4, 16, b"data", data_bytes)


def quantise(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).all():
        raise OutputError("the output holds values that aren't finite")
    return np.trunc(np.clip(x, -1, 1) * 32767).astype("<i2")


def write_track(frames: DataFrame, path: str, folder: str, left: str = "l", right: str = "r", per: int = 1 << 20) -> int:
    """Writes pos, left, right (each position once) as a 16-bit stem; returns its frames.

    Every range of `per` frames becomes a file of samples in the shared folder;
    these are joined behind the header and the whole is renamed into place.
    """
    pieces = frames.select(F.floor(F.col("pos") / per).alias("piece"), "pos", F.col(left).alias("l"), F.col(right).alias("r"))

    def encode(pdf):
        import pandas as pd

        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"piece": [int(pdf.piece.iloc[0])], "first": [int(pdf.pos.iloc[0])], "n": [len(pdf)], "raw": [quantise(pdf[["l", "r"]].to_numpy(np.float64)).tobytes()]})

    pieces.groupBy("piece").applyInPandas(encode, "piece long, first long, n long, raw binary").write.mode("overwrite").parquet(folder)
    done = frames.sparkSession.read.parquet(folder)
    total = done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(header_bytes(total * 4))
        at = 0
        for row in done.orderBy("piece").toLocalIterator():  # one piece at a time
            if row["first"] != at:
                raise OutputError(f"frame {at} is missing")
            f.write(row["raw"])
            at += row["n"]
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    return total
