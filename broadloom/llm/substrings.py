"""Substring dedup with prefix-partitioned suffix trees.

A repeat of ``window`` words is an internal node of the corpus' suffix tree at that depth:
two suffixes or more that share their first ``window`` words. The tree is never built whole.

Suffixes. A window is reached from its anchor, the ``anchor``-word sequence with the smallest
code among those inside it (leftmost of equal ones), so equal windows have equal anchors at
equal places. Its suffix is read from the anchor on to the window's end, then from the word
before the anchor back to the window's start. About ten neighbouring windows share an
anchor, so their suffixes travel as one stretch of words.

Prefixes. Suffixes are dealt by a prefix of their words, of variable length. A first pass
counts the suffixes below every prefix of each length in ``lengths`` (in bins of a table whose
size follows the input's, within bounds); a suffix takes the shortest prefix that at most
``group_windows`` suffixes share, and prefixes are dealt to so many groups that a group holds
about half as many. A prefix that even whole windows share too often (a passage in a third
of all documents) is no burden: its copies pass as they come, see below.

Subtrees. A group's subtree grows from its root downwards: the suffixes below a node are told
apart by their next eight words, those left alone are leaves and go, until the depth of
``window`` words is reached. What is left hangs below deep internal nodes: all suffixes of
one node are the same words, the earliest stays and the others are repeats. Windows that
follow one another merge into maximal repeats (``maximal_repeats``). A group that grows
beyond ``group_windows`` is worked off in pieces, of which only the earliest window of each
node is held on; the piece grows only with the distinct windows.

Words travel as 8 bits of their hash, with 40 bits of the window's hash as the last edge, so
two windows that differ in a single word are taken for one with probability 2**-48, in more
words with less; no text is compared afterwards.
Before the shuffle each slice of a partition sends the earliest of equal windows; later ones
are repeats already. A passage in a third of all documents reaches its group once for each
slice (4 MB), not once for each document.

Defined cases: null or empty texts have no words; rows that repeat a doc_id are one document:
a window at the same start of another of them is not earlier, so equal rows lose the same
words and both return; a null doc_id has no place in the order, so that row removes nothing
and stays whole. Empty tables give an empty
result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.shared import count_strips, shuffle_width, summed_counts, texts
from broadloom.llm.tokens import U, WordHasher, mix, text_slices, word_spans

#: Bits of a mark: which windows of an anchor repeat, the anchor's word index, and a check of
#: the text, for ids with several texts.
OFFSETS, PLACES, TEXTS = 20, 31, 12


def text_check(raw) -> int:
    return zlib.crc32(raw) & (1 << TEXTS) - 1


def rolling(hasher: WordHasher, h: np.ndarray, k: int) -> np.ndarray:
    """Code of each k consecutive word hashes, from prefix sums."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    if len(h) > hasher.size:
        hasher.grow(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * hasher.power[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * hasher.back[: len(h) - k + 1] + U(k))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest (leftmost of equal) of each ``width`` consecutive values."""
    place, have = np.arange(len(x)), 1

    def join(left, right):
        return np.where(x[right] < x[left], right, left)

    while 2 * have <= width:
        place = join(place[:-have], place[have:])
        have *= 2
    return join(place[: len(place) - (width - have)], place[width - have :]) if have < width else place


class Slice:
    """The windows of some texts: which lie in one text, where their anchors are, and which
    are the earliest of their content."""

    def __init__(self, hasher: WordHasher, data, bounds, window: int, anchor: int) -> None:
        self.hasher, self.window = hasher, window
        starts, ends, self.ptr = word_spans(data, bounds)
        self.h = h = hasher(data, starts, ends)
        self.checks = np.array([text_check(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], np.int64)
        self.full = rolling(hasher, h, window)
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(self.ptr))
        self.inside = np.flatnonzero(self.text[: len(self.full)] == self.text[window - 1 :]) if len(self.full) else np.zeros(0, np.int64)
        if len(self.inside):
            self.place = sliding_least(rolling(hasher, h, anchor), window - anchor + 1)

    def earliest(self, ids) -> tuple[np.ndarray, np.ndarray]:
        """(sent, repeat): windows that are the earliest of their content, and windows whose
        words also start earlier; a copy at the earliest one's own place in a repeated row
        of its document is neither."""
        inside, text = self.inside, self.text[self.inside]
        rank = np.empty(len(ids), np.int64)
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        order = np.lexsort((inside, rank[text], self.full[inside]))
        first = np.append(True, np.diff(self.full[inside][order]) != 0)
        lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        at = inside - self.ptr[text]
        same = (ids[text[order]] == ids[text[order[lead]]]) & (at[order] == at[order[lead]])
        return inside[order[first]], inside[order[~same]]

    def prefix(self, length: int, windows: np.ndarray) -> np.ndarray:
        """Code of the first words of the windows' suffixes: those from the anchor on, then,
        where the window ends, those before it; one stretch of words either way."""
        return rolling(self.hasher, self.h, length)[np.minimum(self.place[windows], windows + self.window - length)]


def _slices(batches, window: int, anchor: int):
    hasher = WordHasher()
    for rows, data, bounds in text_slices(batches, budget=1 << 22):
        part = Slice(hasher, data, bounds, window, anchor)
        if len(part.inside):
            yield rows.column(rows.schema.get_field_index("doc_id")).to_numpy(zero_copy_only=False), part


def _count(batches, window: int, anchor: int, lengths, bits: int):
    """Rows (strip, part): windows to be sent, by the bin of their prefix of each length."""
    counts = np.zeros((len(lengths), 1 << bits), np.int64)
    for ids, part in _slices(batches, window, anchor):
        sent, _ = part.earliest(ids)
        for level, length in enumerate(lengths):
            counts[level] += np.bincount((part.prefix(length, sent) >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    yield pa.RecordBatch.from_arrays(list(count_strips(counts.ravel())), names=["strip", "part"])


HEAD = 5  # numbers before a section
EDGE = 8  # words by which the suffixes below a node are told apart at once


def word_letters(h: np.ndarray) -> np.ndarray:
    """The 8 bits of each word's hash that edges are made of."""
    return h.view("<u1")[7::8]


def last_edges(full: np.ndarray) -> np.ndarray:
    """The 40 bits of each window's hash that close its path."""
    return full >> U(24)


def _send(batches, window: int, anchor: int, lengths, heavy: np.ndarray, groups: int):
    """Rows (group, blob): the suffixes of a slice, dealt by their prefixes. ``heavy`` says of
    each length and bin whether too many suffixes share it."""
    shift = U(64 - int(heavy.shape[1] - 1).bit_length())
    for ids, part in _slices(batches, window, anchor):
        parts: dict[int, list[bytes]] = {}
        for flag, chosen in enumerate(part.earliest(ids)):
            chosen = np.sort(chosen)[::-1]  # an anchor's windows one after another, the nearest first
            code, todo = np.zeros(len(chosen), np.uint64), np.ones(len(chosen), bool)
            for level, length in enumerate(lengths):
                if not todo.any():
                    break
                code[todo] = part.prefix(length, chosen[todo])
                todo[todo] = heavy[level][(code[todo] >> shift).astype(np.int64)]
            group = ((mix(code) >> U(32)) * U(groups) >> U(32)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            chosen, group = chosen[order], group[order]
            if not len(chosen):
                continue
            place = part.place[chosen]
            head = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (group[1:] != group[:-1])))
            after = np.append(head[1:], len(chosen))
            mask = np.bitwise_or.reduceat(1 << (place - chosen), head)
            text, own = part.text[chosen[head]], group[head]
            first, n_words = chosen[after - 1], chosen[head] - chosen[after - 1] + window
            at = place[head] - part.ptr[text]
            mask |= part.checks[text] << OFFSETS
            ends = np.cumsum(n_words)
            words = word_letters(part.h[np.repeat(first - ends + n_words, n_words) + np.arange(ends[-1])])
            check = last_edges(part.full[chosen])
            low, high = check.astype("<u4"), (check >> U(32)).astype("u1")
            cut = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                who, row = np.unique(text[a:b], return_inverse=True)
                lo, hi = int(ends[a] - n_words[a]), int(ends[b - 1])
                some = slice(head[a], after[b - 1])
                body = [] if flag else [words[lo:hi], low[some], high[some]]
                wide = int(max(len(who), at[a:b].max()) >= 1 << 16)
                own_rows = [x.astype("<u4" if wide else "<u2") for x in (row, at[a:b])]
                sizes = np.array([flag + 2 * wide, len(who), b - a, *(map(len, body[:2]) if body else (0, 0))], "<u4")
                parts.setdefault(int(own[a]), []).append(b"".join(x.tobytes() for x in (sizes, ids[who].astype("<i8"), *own_rows, mask[a:b].astype("<u4"), *body)))
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([b"".join(p) for p in parts.values()], pa.binary())], names=["group", "blob"])


def _read(blob: bytes):
    """(flag, doc_id, anchor place (below the text's check) and mask of each run, words,
    checks) of each section."""
    at = 0

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(blob, kind, n, at)
        at += found.nbytes
        return found

    while at < len(blob):
        flag, who, n, n_words, n_windows = take("<u4", HEAD).tolist()
        ids = take("<i8", who)
        row, place = (take("<u4" if flag & 2 else "<u2", n).astype(np.int64) for _ in range(2))
        mask = take("<u4", n).astype(np.int64)
        words, low, high = take("u1", n_words), take("<u4", n_windows), take("u1", n_windows)
        checks = high.astype(np.uint64) << U(32) | low
        yield flag & 1, ids[row], place | mask >> OFFSETS << PLACES, mask & (1 << OFFSETS) - 1, words, checks


def spread(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of every window, an anchor's nearest first."""
    return np.nonzero(mask[:, None] >> np.arange(OFFSETS) & 1)


def grow(words: np.ndarray, anchor: np.ndarray, off: np.ndarray, check: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix subtree, from the root down: (suffixes, node) of the suffixes that still
    share a node at the depth of ``window`` words, node by node."""
    left = np.arange(len(anchor))
    node = off  # equal windows hold their anchor at the same place
    ahead = window - off  # words from the anchor to the window's end
    for depth in [*range(0, window, EDGE), window]:
        edge, a, n = np.zeros(len(left), np.uint64), anchor[left], ahead[left]
        for d in range(depth, min(depth + EDGE, window)):
            edge = edge << U(8) | words[np.where(d < n, a + d, a - 1 - (d - n))]
        if depth == window:
            edge = check[left]
        order = np.lexsort((edge, node))
        edge, node, left = edge[order], node[order], left[order]
        new = np.append(True, (edge[1:] != edge[:-1]) | (node[1:] != node[:-1]))[: len(left)]
        node = np.cumsum(new)
        alone = new & np.append(new[1:], True)[: len(left)]
        node, left = node[~alone], left[~alone]
        if not len(left):
            break
    return left, node


class Subtree:
    """The suffixes of one group: pieces are grown as they come, and of each deep node only
    the earliest suffix is held on."""

    def __init__(self, window: int, group_windows: int) -> None:
        self.window, self.most, self.limit = window, group_windows, group_windows
        self.held: list[tuple] = []  # (doc, place, top, mask, words, checks)
        self.n = 0

    def add(self, doc, place, mask, words, checks):
        top = np.log2(mask).astype(np.int64) if len(mask) else mask
        self.held.append((doc, place, top, mask, words, checks))
        self.n += len(checks)
        if self.n >= self.limit:
            yield from self.solve()
            self.limit = max(self.most, 2 * self.n)

    def solve(self):
        if not self.n:
            return
        doc, place, top, mask, words, checks = (np.concatenate(x) for x in zip(*self.held, strict=True))
        bottom = np.log2(mask & -mask).astype(np.int64)
        length = top - bottom + self.window
        begin = np.cumsum(length) - length
        run, off = spread(mask)
        left, node = grow(words, (begin + top)[run], off, checks, self.window)
        start = (place[run] & (1 << PLACES) - 1) - off
        order = np.lexsort((start[left], doc[run[left]], node))
        left, node = left[order], node[order]
        first = np.append(True, node[1:] != node[:-1])[: len(node)]
        lead = left[np.maximum.accumulate(np.where(first, np.arange(len(node)), 0))]
        earlier = (doc[run[left]] != doc[run[lead]]) | (start[left] != start[lead])
        again = np.sort(left[earlier])
        if len(again):
            head = np.flatnonzero(np.append(True, run[again][1:] != run[again][:-1]))
            yield doc[run[again[head]]], place[run[again[head]]] << OFFSETS | np.bitwise_or.reduceat(1 << off[again], head)
        # of each node the earliest stays; stretches shrink to the windows that are left
        stay = np.ones(len(run), bool)
        stay[left[~first]] = False
        kept = np.flatnonzero(stay)
        runs = np.flatnonzero(np.bincount(run[kept], minlength=len(doc)))
        head = np.searchsorted(run[kept], runs)
        mask_ = np.bitwise_or.reduceat(1 << off[kept], head) if len(runs) else mask[:0]
        top_, bottom_ = np.log2(mask_).astype(np.int64), np.log2(mask_ & -mask_).astype(np.int64)
        size = top_ - bottom_ + self.window
        ends = np.cumsum(size)
        own = words[np.repeat(begin[runs] + top[runs] - top_ - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        self.held, self.n = [(doc[runs], place[runs], top_, mask_, own, checks[kept])], len(kept)


def _grow_trees(batches, window: int, group_windows: int):
    def out(found):
        for ids, marks in found:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(marks, pa.int64())], names=["doc_id", "mark"])

    now, tree = None, None
    for batch in batches:
        for group, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if group != now:
                if tree:
                    yield from out(tree.solve())
                now, tree = group, Subtree(window, group_windows)
            for flag, doc, place, mask, words, checks in _read(blob.as_py()):
                yield from out([(doc, place << OFFSETS | mask)] if flag else tree.add(doc, place, mask, words, checks))
    if tree:
        yield from out(tree.solve())


def repeated_windows(docs: DataFrame, window: int = 20, anchor: int = 2, lengths=(2, 4, 8, 14, 20), group_windows: int = 400_000) -> DataFrame:
    """(doc_id, mark): windows whose words also start earlier. A mark packs an anchor's word
    index (upper bits) and a mask of the windows that begin so many words before it."""
    if not 0 <= window - anchor < OFFSETS or sorted(lengths) != list(lengths) or lengths[0] < anchor or lengths[-1] > window:
        raise ValueError("a window is at most 19 words longer than its anchor; prefixes grow from the anchor's length to the window's")
    width = shuffle_width(docs.sparkSession)
    known = texts(docs).filter("doc_id IS NOT NULL")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # an average bin holds an eighth of a group where 4 million bins are enough for it
    bits = min(22, max(12, int(size / 5 / group_windows * 8).bit_length()))
    counts = summed_counts(known.select("doc_id", "text").mapInArrow(lambda b: _count(b, window, anchor, lengths, bits), "strip int, part binary"))
    counts = counts.reshape(len(lengths), -1) if len(counts) else np.zeros((len(lengths), 1 << bits), np.int64)
    total, heavy = int(counts[0].sum()), counts > group_windows
    parts = max(width, -(-total // 2_000_000))
    groups = max(8 * parts, -(-2 * total // group_windows))
    heavy = docs.sparkSession.sparkContext.broadcast(heavy)
    leaves = known.mapInArrow(lambda b: _send(b, window, anchor, lengths, heavy.value, groups), "group int, blob binary")
    dealt = leaves.repartition(parts, "group").sortWithinPartitions("group")
    return dealt.mapInArrow(lambda b: _grow_trees(b, window, group_windows), "doc_id long, mark long")


def keep_mask(n: int, marks, window: int, check: int) -> np.ndarray:
    """Which of n words of the text with this check stay, given its document's marks."""
    marks = np.asarray(marks, np.int64)
    marks = marks[marks >> (OFFSETS + PLACES) == check]
    run, off = spread(marks & (1 << OFFSETS) - 1)
    start = (marks >> OFFSETS & (1 << PLACES) - 1)[run] - off
    start = start[start < n]
    change = np.bincount(start, minlength=n + 1) - np.bincount(np.minimum(n, start + window), minlength=n + 1)
    return np.cumsum(change[:n]) == 0


def _marked(docs: DataFrame, window: int, options: dict) -> DataFrame:
    marks = repeated_windows(docs, window, **options).groupBy("doc_id").agg(F.collect_list("mark").alias("marks"))
    return texts(docs).join(marks.hint("shuffle_hash"), "doc_id", "left").select("doc_id", "text", "marks")


def maximal_repeats(docs: DataFrame, window: int = 20, **options) -> DataFrame:
    """(doc_id, start, n_words): the stretches of a document, in words, that windows which
    also start earlier cover; a row for each stretch."""

    def stretches(batches):
        for batch in batches:
            ids, starts, sizes = [], [], []
            for doc_id, text, m in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                gone = ~keep_mask(len(raw.split()), m.values.to_numpy(), window, text_check(raw))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                ids += [doc_id] * (len(edge) // 2)
                starts += edge[::2].tolist()
                sizes += (edge[1::2] - edge[::2]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, starts, sizes)], names=["doc_id", "start", "n_words"])

    return _marked(docs, window, options).filter("marks IS NOT NULL").mapInArrow(stretches, "doc_id long, start long, n_words long")


def dedup_substrings(docs: DataFrame, window: int = 20, **options) -> DataFrame:
    """doc_id, kept_text (kept words joined by one space), n_words, n_removed, kept_sha256."""

    def rewrite(batches):
        for batch in batches:
            ids, words, removed, kept, sha = [], [], [], [], []
            for doc_id, text, m in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = text.as_py().encode()
                parts = raw.split()  # bytes split at 0x20 and 0x09-0x0D alone
                n = len(parts)
                if m.is_valid:
                    parts = list(compress(parts, keep_mask(n, m.values.to_numpy(), window, text_check(raw)).tolist()))
                body = b" ".join(parts)
                ids.append(doc_id)
                words.append(n)
                removed.append(n - len(parts))
                kept.append(body.decode())
                sha.append(hashlib.sha256(body).hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return _marked(docs, window, options).mapInArrow(rewrite, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")
