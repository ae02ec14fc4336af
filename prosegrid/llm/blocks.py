"""Whole texts as flat numpy arrays, a bounded number of bytes at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa

#: Bytes of text in one block; a longer text is a block of its own.
BLOCK_BYTES = 1 << 18

#: Space and the control characters 9 to 13 separate words.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


#: What workers keep from task to task, by name.
KEPT: dict[str, dict] = {}


def forget(keeps: str | None) -> None:
    """Empty what this worker has kept for tasks of other kinds."""
    for name, cache in KEPT.items():
        if name != keeps:
            cache.clear()


def lean(run: Callable, keeps: str | None = None) -> Callable:
    """A function over batches that hands the memory it freed back to the system when its task ends.

    Python workers are kept from task to task; without this each keeps the
    largest size that any of its tasks had.  What was ``KEPT`` under another
    name than ``keeps`` goes before the task begins.
    """

    @wraps(run)
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return rows


def text_blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of a binary column: ``(first row, end row, bytes, offsets)``; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    if len(texts) == 0:
        return
    large = pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, str]:
    """UTF-8 bytes -> code points, offsets among them, and the text."""
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return points, lead[offsets], text


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64 and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


class Spans:
    """Hashes of any run of a sequence in constant time, by prefix sums modulo 2^64.

    Equal runs have equal hashes wherever they stand, in whatever block.
    """

    def __init__(self, values: np.ndarray):
        up, self._down = powers(len(values) + 1)
        self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)))

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self._sums[hi] - self._sums[lo]) * self._down[lo] + (hi - lo).astype(np.uint64))


class Words:
    """The words of a block: where they start and end, whose they are, and their hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~WHITE[data]
        n = len(data)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], solid))
        after = np.concatenate((solid, [False]))
        self.starts = np.flatnonzero(after & (~before | edge))
        self.ends = np.flatnonzero(before & (~after | edge))
        self.lo = np.searchsorted(self.starts, offsets[:-1])
        self.hi = np.searchsorted(self.starts, offsets[1:])
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.hi - self.lo)
        self.hashes = Spans(data.astype(np.uint64) + np.uint64(1))(self.starts, self.ends)
