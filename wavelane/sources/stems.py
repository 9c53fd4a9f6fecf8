"""The staged pair of stems of one run: written up to a frame, resumed, rewound, published.

Both stems are 16-bit WAV files beside their final places, and a sidecar says for
which job they are. After a checkpoint their headers state what is final, so a
staged stem can be played and a stopped run can go on.
"""

from __future__ import annotations

import os
from contextlib import suppress

from ..errors import InputError, OutputError, SeparationError, WavError
from .sidecar import FRAME_BYTES, HEADER_BYTES, Job
from .wav import header_bytes, read_header


def part(path: str) -> str:
    return f"{path}.part"


def sidecar(vocals: str) -> str:
    return f"{vocals}.part.job"


def discard(vocals: str, background: str) -> None:
    """Gives up a staged pair; nothing else but a fresh start does."""
    for path in (part(vocals), part(background), sidecar(vocals)):
        with suppress(OSError):
            os.remove(path)


def held_frames(vocals: str, background: str, job: Job) -> int:
    """Frames that both staged stems hold for this job; raises ValueError with the reason to start over."""
    try:
        with open(sidecar(vocals), encoding="utf-8") as f:
            saved = Job.decode(f.read())
    except (OSError, UnicodeDecodeError) as e:
        raise ValueError(f"no sidecar: {e}") from e
    if saved != job:
        raise ValueError("the checkpoint is another run's: " + ", ".join(n for n in vars(job) if getattr(saved, n) != getattr(job, n)))
    frames = [job.total_frames]
    for path in (part(vocals), part(background)):
        try:
            size = os.path.getsize(path)
            head = read_header(path, torn=True)
        except (OSError, SeparationError) as e:
            raise ValueError(str(e)) from e
        if (head.channels, head.rate, head.depth, head.data_at) != (2, 44_100, "i16", HEADER_BYTES):
            raise ValueError(f"{path} isn't a stem")
        # A header is written after the samples it counts, but a torn file may be shorter.
        frames += [head.frames, (size - HEADER_BYTES) // FRAME_BYTES]
    if min(frames) <= 0:
        raise ValueError("nothing is final")
    return min(frames)


class StemPair:
    """Open for appending; a context that ends without publishing leaves both stems playable up to their last frame."""

    def __init__(self, vocals: str, background: str, job: Job | None, frames: int):
        """Takes a pair as it is up to `frames`; use `fresh` and `resumed`."""
        self.vocals, self.background, self.frames, self.why = vocals, background, frames, ""
        self._files = []
        try:
            if folder := os.path.dirname(vocals):
                os.makedirs(folder, exist_ok=True)
            for path in (part(vocals), part(background)):
                f = open(path, "r+b" if os.path.exists(path) else "w+b")  # noqa: SIM115
                self._files.append(f)
                # What a stopped run wrote behind its last checkpoint goes.
                f.truncate(HEADER_BYTES + frames * FRAME_BYTES)
            self.checkpoint()
            if job is None:
                # An old sidecar must not vouch for these samples.
                with suppress(FileNotFoundError):
                    os.remove(sidecar(vocals))
            else:
                with open(f"{sidecar(vocals)}.new", "w", encoding="utf-8") as f:
                    f.write(job.encode())
                os.replace(f"{sidecar(vocals)}.new", sidecar(vocals))
        except OSError as e:
            raise InputError(f"{vocals}: {e}") from e

    @classmethod
    def fresh(cls, vocals: str, background: str, job: Job | None = None) -> StemPair:
        """Nothing is kept of what is staged; without a job nothing can be resumed either."""
        return cls(vocals, background, job, 0)

    @classmethod
    def resumed(cls, vocals: str, background: str, job: Job) -> StemPair:
        """What the job has staged is kept; any doubt about it starts over, and `why` tells."""
        try:
            frames, why = held_frames(vocals, background, job), ""
        except ValueError as e:
            frames, why = 0, str(e)
        pair = cls(vocals, background, job, frames)
        pair.why = why
        return pair

    def append(self, vocals: bytes, background: bytes) -> None:
        """Further frames of both stems, as 16-bit stereo."""
        if len(vocals) != len(background) or len(vocals) % FRAME_BYTES:
            raise OutputError("stems must grow alike, by whole frames")
        for f, raw in zip(self._files, (vocals, background), strict=True):
            f.write(raw)
        self.frames += len(vocals) // FRAME_BYTES

    def checkpoint(self) -> None:
        """All frames up to here are final: the headers say so, after the samples."""
        head = header_bytes(self.frames * FRAME_BYTES)
        for f in self._files:
            f.flush()
            f.seek(0)
            f.write(head)
            f.flush()
            os.fsync(f.fileno())
            f.seek(HEADER_BYTES + self.frames * FRAME_BYTES)

    def rewind(self, frames: int) -> None:
        """Back to an earlier frame; what follows it goes."""
        if frames > self.frames:
            raise WavError(f"{part(self.vocals)}: can't rewind forward, from frame {self.frames} to {frames}")
        self.frames = frames
        for f in self._files:
            f.flush()
            f.truncate(HEADER_BYTES + frames * FRAME_BYTES)
        self.checkpoint()

    def publish(self) -> None:
        """Renames the background, then the vocals, whose presence says that both are whole; both or neither."""
        self.checkpoint()
        self._close()
        try:
            os.replace(part(self.background), self.background)
        except OSError as e:
            raise InputError(f"{self.background}: {e}") from e
        try:
            os.replace(part(self.vocals), self.vocals)
        except OSError as e:
            with suppress(OSError):
                os.remove(self.background)
            discard(self.vocals, self.background)
            raise InputError(f"{self.vocals}: {e}") from e
        with suppress(OSError):
            os.remove(sidecar(self.vocals))

    def _close(self) -> None:
        for f in self._files:
            f.close()
        self._files = []

    def close(self) -> None:
        """Ends without publishing; the headers state what was written, if that can still be done."""
        if self._files:
            with suppress(OSError, SeparationError):
                self.checkpoint()
            with suppress(OSError):
                self._close()

    def __enter__(self) -> StemPair:
        return self

    def __exit__(self, *_) -> None:
        self.close()
