"""Words and their 64-bit hashes, computed for whole Arrow batches with numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. These bytes never occur
inside a multi-byte UTF-8 character, so bytes and code points give the same words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def release() -> None:
    """Give freed memory back: Python workers stay alive between tasks, and what one task
    needed for a moment would else be held beside the next executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def byte_spans(values) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow array of strings or binaries without nulls."""
    wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    bounds = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = values.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), bounds


def text_slices(batches, column: str = "text", budget: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``budget`` bytes of text (one row at least), as
    (rows, bytes, offsets). Bounds the numpy memory whatever size a batch has."""
    batch = values = data = None
    for batch in batches:
        values = batch.column(batch.schema.get_field_index(column))
        if values.null_count:
            values = values.fill_null("")
        n, i = len(values), 0
        if not n:
            continue
        data, bounds = byte_spans(values)
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + budget, "right")) - 1)
            yield batch.slice(i, j - i), data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            i = j
    del batch, values, data
    release()


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and for each text the index of its first word
    (one entry more than texts)."""
    sep = (data == 32) | ((data >= 9) & (data <= 13))
    n = len(data)
    cut = np.zeros(n + 1, bool)  # True where a text begins or the bytes end
    cut[bounds] = True
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = sep[:-1]
    after[:-1] = sep[1:]
    starts = np.flatnonzero(~sep & (before | cut[:-1]))
    ends = np.flatnonzero(~sep & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, bounds)


class WordHasher:
    """Polynomial word hashes from prefix sums: no Python step per word."""

    CHUNK = 1 << 19
    BASE = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.size = 0
        self.grow(self.CHUNK)

    def grow(self, size: int) -> None:
        inverse = pow(self.BASE, -1, 1 << 64)
        power = np.full(size + 1, self.BASE, np.uint64)
        back = np.full(size + 1, inverse, np.uint64)
        power[0] = back[0] = 1
        self.power, self.back, self.size = np.cumprod(power), np.cumprod(back), size

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        out = np.empty(len(starts), np.uint64)
        i, n = 0, len(starts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + self.CHUNK, "right")))
            lo, hi = int(starts[i]), int(ends[j - 1])
            if hi - lo > self.size:
                self.grow(hi - lo)
            part = data[lo:hi]
            if lower:
                part = np.where((part >= 65) & (part <= 90), part + 32, part)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + U(1)) * self.power[: hi - lo], out=total[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = (total[e] - total[s]) * self.back[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93)
            i = j
        return mix(out)


#: Fixed odd multipliers, one for each place in a shingle.
PLACES = [pow(0x9FB21C651E98DF25, 2 * j + 1, 1 << 64) | 1 for j in range(64)]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, regardless of text borders (the caller drops those
    that cross one)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.full(n, U(k * 0x2545F4914F6CDD1D & (1 << 64) - 1))
    for j in range(k):
        s += mix(h[j : j + n] + U(PLACES[j])) * U(PLACES[j])
    return mix(s)


def shingle_sets(h: np.ndarray, ptr: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text. A text of fewer words gives
    its whole word sequence as one; a text without words gives none."""
    wide = window_hashes(h, k)
    sets = []
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(wide[a : b - k + 1])
            sets.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            sets.append(window_hashes(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return sets
