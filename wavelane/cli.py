"""The command line: one WAV in, two stems out."""

from __future__ import annotations

import os
import sys
from dataclasses import dataclass

from .config import SAMPLE_RATE
from .errors import EXIT_FAILED, EXIT_OK, EXIT_USAGE, InputError, SeparationError

HELP = """usage: python -m wavelane.cli --model PATH --out DIR [options] INPUT.wav

  -m, --model PATH     the model's graph (.onnx) or weights (.safetensors)
  -o, --out DIR        where vocals.wav and background.wav go
      --window W       samples, or seconds as 4s
      --engine NAME    onnx or network; by default what the model's name says
  -t, --threads N      threads of a session (4)
      --fresh          start over in place of resuming
  -q, --quiet          no progress
  -h, --help           this text
  -V, --version        the version

exit codes: 0 done, 1 failed, 2 wrong command line
"""
VERSION = "0.1.0"


class UsageError(ValueError):
    """A wrong command line."""


@dataclass(frozen=True)
class Args:
    model: str
    input: str
    out_dir: str
    engine: str = "auto"
    window: int | None = None
    threads: int = 4
    fresh: bool = False
    quiet: bool = False


def window_from(text: str) -> int:
    """Samples of '176400' or '4s'; plain decimals only."""
    t = text.strip()
    if t[-1:] in ("s", "S"):
        sec = t[:-1]
        if not sec.strip(".") or set(sec) - set("0123456789.") or sec.count(".") > 1:
            raise UsageError(f"'{t}' is no duration like 4s or 3.5s")
        n = int(float(sec) * SAMPLE_RATE + 0.5)
    elif t.isascii() and t.isdigit():
        n = int(t)
    else:
        raise UsageError(f"'{t}' is neither samples nor a duration like 4s")
    if n == 0:
        raise UsageError("a window of 0 samples is not a window")
    return n


_LONG = {"-m": "--model", "-o": "--out", "-t": "--threads", "-q": "--quiet"}


def parse(argv: list[str]) -> Args | str:
    """Args to run with, or 'help' or 'version'; raises UsageError."""
    got: dict[str, object] = {}
    rest = list(argv)
    while rest:
        word = rest.pop(0)
        name, given, inline = word.partition("=") if word.startswith("--") else (word, "", "")
        name = _LONG.get(name, name)
        if name in ("-h", "--help"):
            return "help"
        if name in ("-V", "--version"):
            return "version"
        if name in ("--fresh", "--quiet"):
            if given:
                raise UsageError(f"{name} takes no value")
            got[name[2:]] = True
        elif name in ("--model", "--out", "--window", "--engine", "--threads"):
            value = inline if given else (rest.pop(0) if rest and not rest[0].startswith("-") else None)
            if not value:
                raise UsageError(f"{name} needs a value")
            if name == "--window":
                value = window_from(value)
            elif name == "--engine" and value not in ("onnx", "network"):
                raise UsageError(f"--engine: '{value}' is neither onnx nor network")
            elif name == "--threads":
                if not value.isdigit():
                    raise UsageError(f"--threads: '{value}' is no number")
                if int(value) < 1:
                    raise UsageError("--threads must be at least 1")
                value = int(value)
            got[{"--out": "out_dir"}.get(name, name[2:])] = value
        elif word.startswith("-") and word != "-":
            raise UsageError(f"unknown option '{word}'")
        elif "input" in got:
            raise UsageError(f"two inputs given; '{word}' is the second")
        else:
            got["input"] = word
    wanted = {"model": "--model PATH", "out_dir": "--out DIR", "input": "INPUT.wav"}
    if missing := [text for k, text in wanted.items() if k not in got]:
        raise UsageError("missing " + ", ".join(missing))
    return Args(**got)  # type: ignore[arg-type]


def choose_engine(args: Args) -> str:
    """What runs the model: as told, else by its file, else onnx."""
    if args.engine != "auto":
        return args.engine
    return "network" if args.model.endswith(".safetensors") else "onnx"


def group_digits(n: int) -> str:
    return f"{n:,}"


def explain(error: SeparationError) -> str:
    return f"{error.kind} error: {error}" + (f"\nhint: {error.hint}" if error.hint else "")


def engine_of(args: Args):
    """(engine maker, grid, MiB that a window needs) of the model; overlap is 1.5 s or 2.5 s, half a window at most."""
    from .operators.admission import network_need_mb, onnx_need_mb
    from .operators.network import Network, NetworkSeparator, Shape, load_weights
    from .operators.onnx_separator import OnnxSeparator
    from .plans.grid import Grid
    from .sources import safetensors

    if not os.path.exists(args.model):
        raise InputError(f"{args.model} doesn't exist")
    if choose_engine(args) == "onnx":
        with open(args.model, "rb") as f:
            model = f.read()
        window = OnnxSeparator(model, args.window, args.threads).window_samples
        return lambda: OnnxSeparator(model, window, args.threads), Grid(window, min(66_150, window // 2)), onnx_need_mb(window)
    weights, window = load_weights(Shape(), safetensors.load(args.model)), args.window or 352_800
    return lambda: NetworkSeparator(Network(Shape(), weights), window), Grid(window, min(110_250, window // 2)), network_need_mb(window)


def separate_file(spark, args: Args, options=None):
    """Reads, separates and writes one track, from its checkpoint if there is one; a Report."""
    from dataclasses import replace

    from .config import Options
    from .streaming.track import separate_track

    if not os.path.exists(args.input):
        raise InputError(f"{args.input} doesn't exist")
    make, grid, need = engine_of(args)
    options = replace(options or Options(), resume=not args.fresh)
    vocals, background = (os.path.join(args.out_dir, f"{n}.wav") for n in ("vocals", "background"))
    return separate_track(spark, args.input, vocals, background, make, grid, args.model, need, options)


def main(argv: list[str]) -> int:
    try:
        args = parse(argv)
    except UsageError as e:
        print(f"{e}\n{HELP}", file=sys.stderr)
        return EXIT_USAGE
    if isinstance(args, str):
        print(HELP if args == "help" else f"wavelane {VERSION}")
        return EXIT_OK
    from pyspark.sql import SparkSession

    from . import ship
    from .config import Options

    spark = SparkSession.builder.appName("wavelane").getOrCreate()
    ship(spark)
    said = Options() if args.quiet else Options(progress=lambda percent, what: print(f"{percent:3d} % {what}", file=sys.stderr))
    try:
        done = separate_file(spark, args, said)
    except SeparationError as e:
        print(explain(e), file=sys.stderr)
        return EXIT_FAILED
    if not args.quiet:
        print(summary(done))
    return EXIT_OK


def summary(r) -> str:
    """What a run did, in a line."""
    kept = f", {group_digits(r.resumed_from)} frames kept" if r.resumed_from else ""
    return f"{group_digits(r.frames)} frames in {r.wall_s:.1f} s, {r.windows_inferred} windows inferred, {r.windows_resumed} skipped{kept}, peak {group_digits(r.peak_mb or 0)} MB"


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
