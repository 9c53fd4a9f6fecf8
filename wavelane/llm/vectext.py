"""Whole-batch text kernels: words, word hashes and window hashes in numpy.

A text column of an Arrow batch is one byte buffer with offsets. Splitting it
into words and hashing every word takes a fixed number of numpy calls for many
documents at once, so the cost is a few nanoseconds a byte and no Python object
is made per word. Batches are worked off in slices of about `SLICE_BYTES`, so
memory is bounded by that size or by the longest single document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; a bijection on 64-bit words."""
    x = np.asarray(x, U).copy()
    x += U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, 4096), U(base))
        full[0] = 1
        have = _POWERS[base] = np.cumprod(full, dtype=U)
    return have[:n]


def byte_table(separators: str | bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, its 64-bit code) for each byte; separators have code 0."""
    word = np.ones(256, bool)
    word[list(separators if isinstance(separators, bytes) else separators.encode("latin-1"))] = False
    code = mix(np.arange(256, dtype=U) + U(0x51ED))
    if lower:
        code[65:91] = code[97:123]
    code[~word] = 0
    return word, code


#: ASCII white space only: space and 09-0D.
SPACES = bytes([32, 9, 10, 11, 12, 13])
#: All ASCII characters that are neither letters nor digits.
NOT_WORD = bytes(b for b in range(128) if not chr(b).isalnum())


class Words:
    """Words of the documents of one slice.

    start, end: byte positions in `buf`; hash: of each word; ptr: words ptr[i]
    to ptr[i+1] belong to document i.
    """

    __slots__ = ("buf", "start", "end", "hash", "ptr", "docs")

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: tuple[np.ndarray, np.ndarray]):
        word, code = table
        self.buf, self.docs = buf, len(off) - 1
        n = len(buf)
        w = word[buf]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        prev = np.zeros(n, bool)
        prev[1:] = w[:-1]
        begins = w & (~prev | edge[:-1])
        nxt = np.zeros(n, bool)
        nxt[:-1] = w[1:]
        ends = w & (~nxt | edge[1:])
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.ptr = np.searchsorted(self.start, off)
        if len(self.start):
            s0 = self.start[0]
            lens = np.diff(np.append(self.start, n))
            pos = np.arange(s0, n) - np.repeat(self.start, lens)
            vals = code[buf[s0:]] * powers(int(lens.max()))[pos]
            self.hash = mix(np.add.reduceat(vals, self.start - s0) ^ (self.end - self.start).astype(U))
        else:
            self.hash = np.zeros(0, U)

    def windows(self, size: int) -> np.ndarray:
        """Hash of the `size` words from each word on; only sense within a document."""
        return window_hash(self.hash, size)

    def inside(self, size: int) -> np.ndarray:
        """Whether `size` words from each word on lie in its document."""
        n = len(self.start)
        left = np.repeat(self.ptr[1:], np.diff(self.ptr)) - np.arange(n)
        return left >= size

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), np.diff(self.ptr))


def window_hash(h: np.ndarray, size: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """sum(h[i+t] * base**t for t < size), by doubling; past the end counts as 0."""
    out, done, level, width, shift = np.zeros(len(h), U), 0, h.copy(), 1, U(1)
    with np.errstate(over="ignore"):
        power = U(base)
        while True:
            if size & width:
                part = np.zeros(len(h), U)
                if done < len(h):
                    part[: len(h) - done] = level[done:]
                out += part * shift
                shift = shift * power
                done += width
            if done == size:
                return mix(out)
            up = level.copy()
            if width < len(h):
                up[: len(h) - width] += level[width:] * power
            level, power, width = up, power * power, width * 2


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """min(x[i:i+size]) for each i with a whole window."""
    m, width = x, 1
    while width * 2 <= size:
        m = np.minimum(m[: len(m) - width], m[width:])
        width *= 2
    rest = size - width
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES):
    """Parts of a batch of at most `limit` text bytes, or of one document."""
    if not batch.num_rows:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(lens.tolist()):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    yield batch.slice(first)
    pa.default_memory_pool().release_unused()  # a worker lives on between tasks


def signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, U).view(np.int64)
