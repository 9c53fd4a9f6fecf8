"""The sidecar that says which run a checkpoint belongs to."""

from __future__ import annotations

import os
from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lambdas import bind

HEADER_BYTES, FRAME_BYTES = 44, 4
FORMAT = 1
# The fields of a sidecar, in order.
FIELDS = ("format", "total_frames", "n_chunks", "window", "overlap", "input_bytes", "input_mtime_ns", "model_bytes", "model_mtime_ns")


@dataclass(frozen=True)
class Job:
    format: int
    total_frames: int
    n_chunks: int
    window: int
    overlap: int
    input_bytes: int
    input_mtime_ns: int
    model_bytes: int
    model_mtime_ns: int

    @classmethod
    def of(cls, total_frames: int, n_chunks: int, window: int, overlap: int, input_path: str, model_path: str) -> Job:
        return cls(FORMAT, total_frames, n_chunks, window, overlap, *stamp(input_path), *stamp(model_path))

    def encode(self) -> str:
        return "# stem checkpoint\n" + "".join(f"{f.name}={v}\n" for f, v in zip(fields(self), astuple(self), strict=True))

    @classmethod
    def decode(cls, text: str) -> Job:
        """Raises ValueError with the reason to start over."""
        got: dict[str, int] = {}
        for line in (x.strip() for x in text.splitlines()):
            if not line or line.startswith("#"):
                continue
            key, sep, value = line.partition("=")
            if not sep:
                raise ValueError(f"not key=value: {line}")
            key = key.strip()
            if key not in FIELDS:
                continue
            if key in got:
                raise ValueError(f"{key} is given twice")
            if not value.strip().isdecimal():
                raise ValueError(f"{key}: {value.strip()!r} is no number")
            got[key] = int(value)
        if missing := [f for f in FIELDS if f not in got]:
            raise ValueError(f"{len(missing)} fields are missing")
        return cls(**got)


def stamp(path: str) -> tuple[int, int]:
    """Size and modification time in nanoseconds; zeros for no file."""
    try:
        s = os.stat(path)
    except OSError:
        return 0, 0
    return s.st_size, s.st_mtime_ns


def encode(rows: DataFrame, *keys: str) -> DataFrame:
    """keys and the sidecar text of rows with the nine fields."""
    lines = [F.concat(F.lit(f"{f}="), F.col(f).cast("string")) for f in FIELDS]
    return rows.select(*keys, F.concat_ws("\n", F.lit("# stem checkpoint"), *lines, F.lit("")).alias("sidecar"))


def decode(text: Column) -> Column:
    """struct of the nine fields and fault, which is null if the text is a whole sidecar."""
    blank = r"[^\S\n]*"
    # A field's line from its equals sign on; nothing if it is missing.
    found = F.array(*[F.regexp_extract(text, rf"(?m)^{blank}{f}{blank}(=[^\n]*)$", 1) for f in FIELDS])
    given = F.regexp_count(text, F.lit(rf"(?m)^{blank}(?:{'|'.join(FIELDS)}){blank}="))
    bad_line = text.rlike(rf"(?m)^{blank}[^\s#=][^=\n]*$")

    def read(found: Column) -> Column:
        values = [F.trim(F.substring(F.get(found, F.lit(k)), 2, 1 << 20)) for k in range(len(FIELDS))]
        n = F.size(F.filter(found, lambda x: x != ""))
        bad_number = F.exists(found, lambda x: (x != "") & ~x.rlike(r"^=\s*[0-9]+\s*$"))
        fault = F.when(bad_line, "not key=value").when(given > n, "repeated field").when(n < len(FIELDS), F.concat(F.lit(len(FIELDS)) - n, F.lit(" fields are missing"))).when(bad_number, "no number")
        return F.struct(*[v.try_cast("long").alias(f) for v, f in zip(values, FIELDS, strict=True)], fault.alias("fault"))

    none = F.struct(*[F.lit(None).cast("long").alias(f) for f in FIELDS], F.lit("no sidecar").alias("fault"))
    return F.when(text.isNull(), none).otherwise(bind(found, read))


def difference(a: str, b: str) -> Column:
    """How the run of struct b differs from that of struct a."""
    x, y = (lambda n, s=s: F.col(f"{s}.{n}").cast("string") for s in (a, b))
    grid = lambda g: F.concat_ws("/", g("window"), g("overlap"))
    file = lambda g, k: F.concat(g(f"{k}_bytes"), F.lit("B@"), g(f"{k}_mtime_ns"), F.lit("ns"))
    parts = [
        *[F.when(x(n) != y(n), F.concat(F.lit(f"{label} "), x(n), F.lit(" vs "), y(n))) for n, label in (("format", "format"), ("total_frames", "frames"), ("n_chunks", "chunks"))],
        F.when(grid(x) != grid(y), F.concat(F.lit("grid "), grid(x), F.lit(" vs "), grid(y))),
        F.when(file(x, "input") != file(y, "input"), F.concat(F.lit("input "), file(x, "input"), F.lit(" vs "), file(y, "input"))),
        F.when(file(x, "model") != file(y, "model"), F.lit("model changed")),
    ]
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", "identical").otherwise(text)


def resume_frames(stems: DataFrame, keys: list[str]) -> DataFrame:
    """keys, frames: what both stems of a pair hold; null refuses (a missing or short stem, or nothing final).

    stems: keys, declared (frames of the header), bytes (of the file), total.
    """
    held = F.least("declared", F.floor((F.col("bytes") - HEADER_BYTES) / FRAME_BYTES))
    got = stems.groupBy(*keys).agg(F.count(F.when(F.col("bytes") >= HEADER_BYTES, 1)).alias("n"), F.min(held).alias("held"), F.max("total").alias("total"))
    frames = F.least("held", "total")
    return got.select(*keys, F.when((F.col("n") == 2) & (frames > 0), frames).alias("frames"))


def staging_names(path: Column) -> Column:
    """struct(part, job) beside a stem's final path."""
    return F.struct(F.concat(path, F.lit(".part")).alias("part"), F.concat(path, F.lit(".part.job")).alias("job"))
