"""Admission: whether a window may start, and what memory there is."""

from __future__ import annotations

import os
import re
import subprocess
import sys
import threading
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import MemoryRefusal

#: Counters of a snapshot, all in MiB and all null where unknown.
FIELDS = ("avail_phys_mb", "total_phys_mb", "commit_avail_mb", "commit_limit_mb", "proc_commit_mb", "proc_peak_commit_mb", "proc_rss_mb", "proc_peak_rss_mb")

# What texts of failed allocations contain.
MARKERS = ("bfcarena", "failed to allocate", "memory allocation of", "bad allocation", "bad_alloc", "out of memory", "not enough memory", "insufficient memory", "cannot allocate", "memory gate:")


def snapshot() -> dict[str, int | None]:
    """This machine's counters; None where the system doesn't tell."""
    if sys.platform == "darwin":
        return mac_counters(_said("vm_stat"), _said("sysctl", "-n", "hw.memsize"), _said("ps", "-o", "rss=", "-p", str(os.getpid())))
    if sys.platform == "win32":
        return _windows()
    return _linux()


def _said(*command: str) -> str:
    try:
        return subprocess.run(command, capture_output=True, text=True, timeout=5, check=False).stdout
    except (OSError, subprocess.SubprocessError):
        return ""


def mac_counters(vm_stat: str, memsize: str, rss: str) -> dict[str, int | None]:
    """From what vm_stat, sysctl and ps say; free, inactive and speculative pages are to be had."""
    size = re.search(r"page size of (\d+) bytes", vm_stat)
    pages = [re.search(rf"Pages {k}:\s+(\d+)", vm_stat) for k in ("free", "inactive", "speculative")]
    out = dict.fromkeys(FIELDS)
    if size and pages[0]:
        out["avail_phys_mb"] = sum(int(p[1]) for p in pages if p) * int(size[1]) >> 20
    if memsize.strip().isdigit():
        out["total_phys_mb"] = int(memsize) >> 20
    if rss.strip().isdigit():
        out["proc_rss_mb"] = int(rss) >> 10
    return out


def _windows() -> dict[str, int | None]:
    """By the system's own calls; commit is what the page file may still take."""
    import ctypes

    long, size = ctypes.c_ulonglong, ctypes.c_size_t
    status = type("Status", (ctypes.Structure,), {"_fields_": [("length", ctypes.c_ulong), ("load", ctypes.c_ulong), *[(n, long) for n in ("total", "avail", "limit", "commit", "virtual", "avail_virtual", "extended")]]})()
    held = type("Held", (ctypes.Structure,), {"_fields_": [("cb", ctypes.c_ulong), ("faults", ctypes.c_ulong), *[(n, size) for n in ("peak_rss", "rss", "a", "b", "c", "d", "commit", "peak_commit", "private")]]})()
    status.length, held.cb = ctypes.sizeof(status), ctypes.sizeof(held)
    out = dict.fromkeys(FIELDS)
    if ctypes.windll.kernel32.GlobalMemoryStatusEx(ctypes.byref(status)):
        out |= {"avail_phys_mb": status.avail >> 20, "total_phys_mb": status.total >> 20, "commit_avail_mb": status.commit >> 20, "commit_limit_mb": status.limit >> 20}
    ctypes.windll.kernel32.GetCurrentProcess.restype = ctypes.c_void_p
    if ctypes.windll.psapi.GetProcessMemoryInfo(ctypes.c_void_p(ctypes.windll.kernel32.GetCurrentProcess()), ctypes.byref(held), held.cb):
        out |= {"proc_commit_mb": held.commit >> 20, "proc_peak_commit_mb": held.peak_commit >> 20, "proc_rss_mb": held.rss >> 20, "proc_peak_rss_mb": held.peak_rss >> 20}
    return out


def _linux() -> dict[str, int | None]:
    """From /proc."""

    def fields(path: str) -> dict[str, int]:
        try:
            with open(path) as f:
                return {a.strip(): int(b.split()[0]) // 1024 for a, _, b in (line.partition(":") for line in f) if b.split() and b.split()[0].isdigit()}
        except OSError:
            return {}

    mem, own = fields("/proc/meminfo"), fields("/proc/self/status")
    try:
        with open("/proc/sys/vm/overcommit_memory") as f:
            strict = f.read().strip() == "2"
    except OSError:
        strict = False
    limit, used = mem.get("CommitLimit"), mem.get("Committed_AS")
    return {
        "avail_phys_mb": mem.get("MemAvailable"),
        "total_phys_mb": mem.get("MemTotal"),
        "commit_avail_mb": max(limit - used, 0) if strict and limit is not None and used is not None else None,
        "commit_limit_mb": limit if strict else None,
        "proc_commit_mb": own.get("VmData"),
        "proc_peak_commit_mb": None,
        "proc_rss_mb": own.get("VmRSS"),
        "proc_peak_rss_mb": own.get("VmHWM"),
    }


def snapshot_frame(spark: SparkSession) -> DataFrame:
    now = snapshot()
    return spark.createDataFrame([tuple(now[f] for f in FIELDS)], ", ".join(f"{f} long" for f in FIELDS))


def held() -> Column:
    return F.coalesce("proc_commit_mb", "proc_rss_mb")


def ceiling() -> Column:
    """Commit headroom, else available memory, else installed less held; null if none is known."""
    return F.coalesce("commit_avail_mb", "avail_phys_mb", F.when(F.col("total_phys_mb").isNotNull(), F.greatest(F.col("total_phys_mb") - F.coalesce(held(), F.lit(0)), F.lit(0))))


def fits(need: Column) -> Column:
    """Null where commit isn't counted."""
    return F.col("commit_avail_mb") >= need


def refuses(need: Column, budget: Column, limit: Column) -> Column:
    """Only more than the budget, or else the ceiling, is refused; nothing known refuses nothing."""
    return F.coalesce(need > F.coalesce(budget, limit), F.lit(False))


def is_allocation_failure(text: Column) -> Column:
    low = F.lower(text)
    hit = F.lit(False)
    for m in MARKERS:
        hit = hit | F.contains(low, F.lit(m))
    return hit & ~F.contains(low, F.lit("cancel"))


def summary(row: dict[str, int | None]) -> str:
    t = {k: "?" if v is None else str(v) for k, v in row.items()}
    return "phys {avail_phys_mb}/{total_phys_mb}MB commit {commit_avail_mb}/{commit_limit_mb}MB proc {proc_commit_mb}(peak {proc_peak_commit_mb})/{proc_rss_mb}(peak {proc_peak_rss_mb})MB".format(**t)


def admit(need_mb: int, budget_mb: int | None = None, now: dict[str, int | None] | None = None) -> None:
    """Raises MemoryRefusal if a window of this need is refused here."""
    now = snapshot() if now is None else now
    limit = budget_mb
    if limit is None:
        own = now["proc_commit_mb"] if now["proc_commit_mb"] is not None else now["proc_rss_mb"]
        rest = None if now["total_phys_mb"] is None else max(now["total_phys_mb"] - (own or 0), 0)
        limit = next((x for x in (now["commit_avail_mb"], now["avail_phys_mb"], rest) if x is not None), None)
    if limit is not None and need_mb > limit:
        raise MemoryRefusal(need_mb, limit)


def onnx_need_mb(window: int) -> int:
    """By the curve through the two measured windows."""
    slope = (19_400 - 5_100) / (352_800**2 - 176_400**2)
    return max(round(5_100 + slope * (window**2 - 176_400**2)), 0)


def network_need_mb(window: int, bands: int = 60, heads: int = 8, inner: int = 512, dim: int = 384, hop: int = 441) -> int:
    """By the sizes of the largest arrays: scores and their shares, projections, activations and the host's buffers."""
    frames = window // hop + 1
    values = (bands * heads * frames**2, bands * heads * frames**2, bands * frames * 3 * inner, 4 * frames * bands * dim, 7 * window)
    return sum(-(-4 * v // (1 << 20)) for v in values)


class Peak:
    """The most this process held while a block ran, in MiB."""

    mb: int = 0


@contextmanager
def peak_mb(every_s: float = 0.02):
    peak, done = Peak(), threading.Event()

    def look() -> None:
        now = snapshot()
        peak.mb = max(peak.mb, now["proc_commit_mb"] or now["proc_rss_mb"] or 0)

    def sample() -> None:
        while not done.is_set():
            look()
            time.sleep(every_s)

    thread = threading.Thread(target=sample, daemon=True)
    look()
    thread.start()
    try:
        yield peak
    finally:
        done.set()
        thread.join()
        look()
