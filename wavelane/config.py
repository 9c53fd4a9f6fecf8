"""Options, progress, cancellation and reports of a run."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from .errors import Cancelled

SAMPLE_RATE = 44_100


class CancelFlag:
    """Set from anywhere; looked at between windows only."""

    def __init__(self) -> None:
        self._event = threading.Event()

    def cancel(self) -> None:
        self._event.set()

    def is_cancelled(self) -> bool:
        return self._event.is_set()

    def check(self) -> None:
        if self.is_cancelled():
            raise Cancelled("cancelled between windows")


def percent(done: int, total: int) -> int:
    """Finished frames as whole percent, rounded down; 100 of nothing."""
    return 100 if total == 0 else min(done, total) * 100 // total


@dataclass(frozen=True)
class Options:
    """How to run; `with_*` give changed copies.

    overlap and window: null for the engine's own. memory_budget_mb: what one window
    may need, in place of what the machine reports. windows_at_once: null for the
    number of the cluster's cores; also how many windows lie between checkpoints.
    """

    overlap: int | None = None
    window: int | None = None
    threads: int = 4
    resume: bool = True
    memory_budget_mb: int | None = None
    windows_at_once: int | None = None
    progress: Callable[[int, str], None] | None = None
    cancel: CancelFlag = field(default_factory=CancelFlag)

    def with_progress(self, progress: Callable[[int, str], None]) -> Options:
        return replace(self, progress=progress)

    def with_cancel(self, cancel: CancelFlag) -> Options:
        return replace(self, cancel=cancel)

    def with_memory_budget_mb(self, mb: int) -> Options:
        return replace(self, memory_budget_mb=mb)

    def report(self, done: int, total: int, phase: str) -> None:
        if self.progress:
            self.progress(percent(done, total), phase)


@dataclass(frozen=True)
class Report:
    """What a run did."""

    rate: int
    frames: int
    windows_inferred: int
    windows_resumed: int
    resumed_from: int  # frames that were final already
    peak_mb: int | None
    wall_s: float

    @property
    def real_time_factor(self) -> float:
        seconds = self.frames / self.rate
        return self.wall_s / seconds if seconds else 0.0
