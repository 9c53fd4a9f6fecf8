"""What can go wrong, by kind."""

from __future__ import annotations


class SeparationError(Exception):
    """Base of all errors of the library."""

    kind = "error"
    hint = ""


class InputError(SeparationError):
    """A file that can't be read or written."""

    kind = "io"
    hint = "check that the path exists and may be read"


class WavError(SeparationError):
    """A track that isn't a WAV this library takes."""

    kind = "wav"
    hint = "convert the track to 16-, 24- or 32-bit integer or 32-bit float WAV"


class ResampleError(SeparationError):
    kind = "resample"
    hint = "check the sample rates"


class ModelError(SeparationError):
    """A model file or graph that doesn't fit."""

    kind = "model"
    hint = "check the model file"


class SessionError(SeparationError):
    """The runtime failed while a window was inferred."""

    kind = "session"
    hint = "try a shorter window"


class OutputError(SeparationError):
    """What the model gave can't be used."""

    kind = "output"
    hint = "the model may not be a two-source separator"


class MemoryRefusal(SeparationError):
    """The admission gate refused to start."""

    kind = "memory"
    hint = "use a shorter window, or set a memory budget"

    def __init__(self, need_mb: int, avail_mb: int | None):
        self.need_mb, self.avail_mb = need_mb, avail_mb
        super().__init__(f"memory gate: a window needs about {need_mb} MB, {'unknown' if avail_mb is None else avail_mb} MB are available")


class Cancelled(SeparationError):
    kind = "cancelled"
    hint = "run again to go on from the checkpoint"


class Unsupported(SeparationError):
    kind = "unsupported"
    hint = "this build lacks what was asked for"


#: Exit code of the command line for success, a failed run and a wrong command.
EXIT_OK, EXIT_FAILED, EXIT_USAGE = 0, 1, 2
