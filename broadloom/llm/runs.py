"""Periodic runs of words: naming of stretches of power-of-two length (Karp, Miller and
Rosenberg), common extensions by descending levels of names, candidates on a grid.

A run is a stretch of consecutive words whose smallest period is q, at least ``least`` words
and ``3 * q`` long, that neither neighbour extends at that period.

Naming: level 0 names a place by its word (words are told apart exactly, by an Arrow
dictionary); level k+1 names it by the pair of level-k names at i and i + 2**k, so that equal
names mean equal stretches. A place whose name occurs once keeps a name of its own, and only
the others go on to the next level: naming ends as soon as no stretch repeats. The common
extension of two places steps down the levels, one comparison a level.

Grid: in a run of period q all of ``max(2 * q, least - q)`` neighbouring places i at least
have word i equal to word i + q, so places that many apart meet every such run. That is
O(n log n) places a document over all periods; each is extended to both sides at once for all
places of a slice.

Documents are read in slices of a megabyte (one document at least), so memory follows the
slice or the longest text: some 8 bytes a word for each level, and there are at most
log2 n levels. Nothing is shuffled.

Defined results: null, empty and blank texts have no words and no run; a null doc_id is
never put to the doubling of ``doubled`` and comes back as null; repeated rows each give
their row; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from broadloom.llm.shared import texts
from broadloom.llm.tokens import text_slices, word_spans

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
CHUNK = 1 << 20  # grid places that are extended together


def word_names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """An int32 for each word, equal exactly where the words are."""
    if not len(starts):
        return np.zeros(0, np.int32)
    sep = (data == 32) | ((data >= 9) & (data <= 13))
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~sep]))])
    return np.array(words.dictionary_encode().indices, np.int32)


def name_levels(words: np.ndarray) -> list[np.ndarray]:
    """Level k names the stretch of 2**k places from each place on. A negative name occurs
    once; a place without room has one too. The last level holds no repeated name."""
    n = len(words)
    alone = -1 - np.arange(n, dtype=np.int32)
    counts = np.bincount(words, minlength=1) if n else np.zeros(1, np.int64)
    level = np.where(counts[words] > 1, words, alone)
    levels, step = [level], 1
    live = np.flatnonzero(level >= 0)
    while len(live):
        live = live[live + step < n]
        left, right = level[live], level[live + step]
        both = right >= 0
        live, pair = live[both], left[both].astype(np.int64) << 32 | right[both]
        _, names, count = np.unique(pair, return_inverse=True, return_counts=True)
        level = alone.copy()
        again = count[names] > 1
        live = live[again]
        level[live] = names[again]
        levels.append(level)
        step *= 2
    return levels


def extend(levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
    """How far the stretches from x and y on (``back``: those that end before x and y) agree."""
    n = len(levels[0])
    x, y, got = x.copy(), y.copy(), np.zeros(len(x), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        if back:
            room = x >= step
            a, b = np.where(room, x - step, 0), np.where(room, y - step, 0)
        else:
            room = y + step <= n
            a, b = np.where(room, x, 0), np.where(room, y, 0)
        same = room & (levels[k][a] == levels[k][b])
        move = np.where(same, step, 0)
        got += move
        x, y = (x - move, y - move) if back else (x + move, y + move)
    return got


def grid(first: np.ndarray, size: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of all grid places of documents that begin at ``first`` and hold
    ``size`` words, about ``CHUNK`` at a time."""
    periods = np.where(size >= least, size // 3, 0)
    doc = np.repeat(np.arange(len(size)), periods)
    q = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    gap = np.maximum(2 * q, least - q)
    places = (size[doc] - q - 1) // gap + 1  # places 0, gap, 2 gap ... below size - q
    total = np.concatenate([[0], np.cumsum(places)])
    i = 0
    while i < len(doc):
        j = max(i + 1, int(np.searchsorted(total, total[i] + CHUNK, "right")) - 1)
        which = np.repeat(np.arange(i, j), places[i:j])
        nth = np.arange(len(which)) - np.repeat(total[i:j] - total[i], places[i:j])
        yield first[doc[which]] + nth * gap[which], q[which]
        i = j


def runs_of(words: np.ndarray, first: np.ndarray, size: np.ndarray, least: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period; ``words`` holds the documents one
    after the other with a word of no other place between any two."""
    levels = name_levels(words)
    parts = [np.zeros((0, 3), np.int64)]
    for x, q in grid(first, size, least):
        y = x + q
        hit = levels[0][x] == levels[0][y]
        hit &= levels[0][x] >= 0
        x, y, q = x[hit], y[hit], q[hit]
        start, end = x - extend(levels, x, y, back=True), y + extend(levels, x, y)
        long = end - start >= np.maximum(least, 3 * q)
        parts.append(np.unique(np.stack([start[long], end[long], q[long]], 1), axis=0))
    found = np.unique(np.concatenate(parts), axis=0)  # by start, end, period
    # one stretch under several periods: all are multiples of the smallest
    smallest = np.ones(len(found), bool)
    smallest[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[smallest]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """Index of the run of greatest length / period, compared exactly; ties: smallest start,
    then period (the order they come in)."""
    ratio = length / period
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9))
    best = int(near[0])
    for i in near[1:].tolist():
        if int(length[i]) * int(period[best]) > int(length[best]) * int(period[i]):
            best = i
    return best


def doubled(doc_id: int | None, n: int) -> np.ndarray | None:
    """Where the words of a document come from: one document in ten has its tail filled with
    repeats of a stretch, by a rule over crc32(doc_id). None: the words stay."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    source = np.arange(n)
    source[a:] = a + (source[a:] - a) % p
    return source


def _report(batches: Iterator[pa.RecordBatch], damage: bool, least: int) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in text_slices(batches):
        ids = rows.column(0).to_pylist()
        starts, ends, ptr = word_spans(data, bounds)
        names = word_names(data, starts, ends)
        if damage:
            for k, doc_id in enumerate(ids):
                a, b = int(ptr[k]), int(ptr[k + 1])
                if (source := doubled(doc_id, b - a)) is not None:
                    starts[a:b], ends[a:b], names[a:b] = starts[a:b][source], ends[a:b][source], names[a:b][source]
        size, n_docs = np.diff(ptr), len(ids)
        first = ptr[:-1] + np.arange(n_docs)  # a separator stands after each document
        stream = np.empty(len(names) + n_docs, np.int32)
        at = np.ones(len(stream), bool)
        at[first + size] = False
        stream[at] = names
        stream[~at] = int(names.max(initial=-1)) + 1 + np.arange(n_docs)
        start, end, period = runs_of(stream, first, size, least)
        split = np.searchsorted(start, np.append(first, len(stream)))
        raw, out = data.tobytes(), []
        for k, doc_id in enumerate(ids):
            a, b, low, high = int(ptr[k]), int(ptr[k + 1]), int(split[k]), int(split[k + 1])
            s, length, q = start[low:high] - first[k], (end - start)[low:high], period[low:high]
            kept = np.ones(b - a, bool)
            best = (None, None, None, None)
            if len(s):
                cover = np.zeros(b - a + 1, np.int64)
                np.add.at(cover, s + q, 1)
                np.add.at(cover, s + length, -1)
                kept = np.cumsum(cover[:-1]) == 0
                i = strongest(s, length, q)
                best = (int(s[i]), int(length[i]), int(q[i]), 1000 * int(length[i]) // int(q[i]))
            listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), length.tolist(), q.tolist(), strict=True))
            collapsed = b" ".join(raw[x:y] for x, y in zip(starts[a:b][kept].tolist(), ends[a:b][kept].tolist(), strict=True))
            out.append((doc_id, len(s), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest()))
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(c, pa.string()) for c in columns[6:]], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def periodic_runs(docs: DataFrame, damage: bool = False, least: int = 24) -> DataFrame:
    """One row for each document: number of runs, the run of the greatest exponent, digests of
    all runs and of the text without what repeats. ``damage``: after ``doubled``."""
    return texts(docs).mapInArrow(lambda batches: _report(batches, damage, least), SCHEMA)


def without_runs(docs: DataFrame, least: int = 24) -> DataFrame:
    """(doc_id, text, n_dropped): each document with the first period of every run alone; words
    that stay are joined by one space. A document without a run keeps its text as it is."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in text_slices(batches):
            starts, ends, ptr = word_spans(data, bounds)
            names = word_names(data, starts, ends)
            raw, out, gone = data.tobytes(), [], []
            for k in range(len(bounds) - 1):
                a, b = int(ptr[k]), int(ptr[k + 1])
                kept = np.ones(b - a, bool)
                s, e, q = runs_of(names[a:b], np.zeros(1, np.int64), np.array([b - a]), least)
                for x, y in zip((s + q).tolist(), e.tolist(), strict=True):
                    kept[x:y] = False
                gone.append(int((~kept).sum()))
                whole = raw[bounds[k] : bounds[k + 1]]
                out.append((b" ".join(raw[x:y] for x, y in zip(starts[a:b][kept].tolist(), ends[a:b][kept].tolist(), strict=True)) if gone[-1] else whole).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(out, pa.string()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_dropped"])

    return texts(docs).mapInArrow(collapse, "doc_id long, text string, n_dropped long")
