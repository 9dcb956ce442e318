"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over consecutive words: it hashes the words under its ones and ignores
those under its zeros, so a substituted word that falls on a zero does not hide a match.
Seeds of every benchmark item are joined with the seeds of every document position; each
hit fixes an alignment, along which the words of item and document are compared, and an
overlap of enough words, most of them equal, convicts.

Words are compared in lower case. Defined cases: null or empty texts match nothing;
items of fewer words than ``least`` are no evidence and match nothing (with ``least`` 1 every
item with a word counts); items of 4 to 12 words have shorter masks, those below 4 words are
looked up word for word; very long texts are scanned whole, in slices; repeated items and items with one text each report;
rows that repeat a doc_id report once; rows with a null doc_id and items with a null
item_id match nothing, so such rows stay. Empty tables give an empty result. Columns other than
doc_id, item_id and text are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.shared import fresh, texts
from broadloom.llm.tokens import U, WordHasher, mix, text_slices, word_spans

#: With a tolerance of a quarter no overlap is lost: wherever 3 of 13 words are changed, 4 of
#: 16, 5 of 20 and so on, one of these masks is whole at some place (tests try all placements).
MASKS = ("110111", "101001011", "111010001", "111011")
#: The same for items of 4 to 12 words, whichever quarter of them is changed.
SHORT_MASKS = ("111", "1101", "1011")
LONG, SHORT = 13, 4


def masks_of(n: int) -> tuple[str, ...]:
    """The masks of an item of n words."""
    return MASKS if n >= LONG else SHORT_MASKS if n >= SHORT else ("1" * n,)


def masks_for(lengths) -> list[str]:
    """All masks of items of these lengths."""
    return sorted({m for n in lengths for m in masks_of(n)})


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.full(n, U(int(mask, 2) * 0x2545F491 + len(mask)))
    for j, c in enumerate(mask):
        if c == "1":
            s = mix(s ^ h[j : j + n]) + U(j + 1)
    return s


def item_seeds(h: np.ndarray):
    """(hash, place) of all seeds of an item."""
    for m in masks_of(len(h)):
        yield from ((int(x), i) for i, x in enumerate(seed_hashes(h, m)))


def best_overlap(item: np.ndarray, doc: np.ndarray, offset: int, tolerance: float) -> tuple[int, int]:
    """(words, equal words) of the whole alignment if enough of the item is equal, else of the
    longest stretch that begins and ends with equal words and has at most ``tolerance`` of
    different ones; of stretches of one length, that with the most equal words."""
    a, b = max(0, -offset), min(len(item), len(doc) - offset)
    if b <= a:
        return 0, 0
    same = item[a:b] == doc[offset + a : offset + b]
    if same.sum() >= (1 - tolerance) * len(item):  # the whole item, differences at its ends included
        return b - a, int(same.sum())
    starts = np.flatnonzero(same)
    if not len(starts):
        return 0, 0
    part, whole = Fraction(tolerance).limit_denominator(10**6).as_integer_ratio()
    equal = np.concatenate([[0], np.cumsum(same)])
    worth = whole * equal - (whole - part) * np.arange(len(equal))  # never falls over a stretch within tolerance
    # the first start from which each end is no fall; the least worth so far falls from start to start
    ends = starts + 1
    begin = starts[np.searchsorted(-np.minimum.accumulate(worth[starts]), -worth[ends])]
    n, same = max(zip((ends - begin).tolist(), (equal[ends] - equal[begin]).tolist(), strict=True))
    return n, same


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 8, overlap: int = 13, tolerance: float = 0.25, broadcast_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, overlap_words, equal_words, item_words), a row for each document and
    item whose best overlap has at least min(overlap, item length) words with at most
    ``tolerance`` of them different.

    A benchmark of at most ``broadcast_words`` words (counted first) is broadcast and looked
    up while documents are scanned; a larger one is joined by seed hash with a shuffle.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text")).filter("item_id IS NOT NULL")
    words = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)) / 2).first()[0]  # two characters a word, or more
    docs = texts(docs).filter("doc_id IS NOT NULL").withColumn("text", F.lower("text"))
    find = _by_broadcast if words <= broadcast_words else _by_shuffle
    hits = find(docs, items, least, overlap, tolerance)
    return hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("equal_words", "overlap_words", "item_words")).alias("m")).select("doc_id", "item_id", "m.overlap_words", "m.equal_words", "m.item_words")


SCHEMA = "doc_id long, item_id long, overlap_words int, equal_words int, item_words int"


def _rows(found: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    columns = zip(*found, strict=True) if found else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "overlap_words", "equal_words", "item_words"])


def _judge(ids, doc, item, offset, least, overlap, tolerance):
    n, same = best_overlap(item, doc, offset, tolerance)
    if len(item) >= least and n >= min(overlap, len(item)) and n - same <= tolerance * n:
        yield (*ids, n, same, len(item))


def _by_broadcast(docs, items, least, overlap, tolerance):
    hasher = WordHasher()
    known: list[tuple[int, np.ndarray]] = []
    for r in items.collect():  # at most broadcast_words words, checked by the caller
        data = np.frombuffer(r["text"].encode(), np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]))
        if len(starts) >= max(1, least):
            known.append((r["item_id"], hasher(data, starts, ends)))
    seeds = [(x, i, at) for i, (_, h) in enumerate(known) for x, at in item_seeds(h)]
    masks = masks_for({len(h) for _, h in known})
    seeds.sort()
    keys = np.array([s[0] for s in seeds], np.uint64)
    owner, place = np.array([s[1] for s in seeds], np.int64), np.array([s[2] for s in seeds], np.int64)
    filled = np.zeros(1 << 20, bool)  # most seeds of a document end here
    filled[keys >> U(44)] = True
    table = docs.sparkSession.sparkContext.broadcast((known, keys, owner, place, filled))

    def scan(batches):
        known, keys, owner, place, filled = table.value
        hasher = WordHasher()
        for rows, data, bounds in text_slices(batches, budget=1 << 20):
            ids = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
            starts, ends, ptr = word_spans(data, bounds)
            h = hasher(data, starts, ends)
            tries = set()
            for mask in masks:
                s = seed_hashes(h, mask)
                near = np.flatnonzero(filled[s >> U(44)])
                lo, hi = np.searchsorted(keys, s[near], "left"), np.searchsorted(keys, s[near], "right")
                for at, a, b in zip(near[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    text = int(np.searchsorted(ptr, at, "right")) - 1
                    if at + len(mask) <= ptr[text + 1]:
                        tries.update((text, int(owner[k]), at - int(ptr[text]) - int(place[k])) for k in range(a, b))
            found = []
            for text, i, offset in sorted(tries):
                found += _judge((ids[text], known[i][0]), h[ptr[text] : ptr[text + 1]], known[i][1], offset, least, overlap, tolerance)
            yield _rows(found)

    return docs.mapInArrow(scan, SCHEMA)


def _by_shuffle(docs, items, least, overlap, tolerance):
    n_words = F.least(F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda w: w != "")), F.lit(LONG))
    lengths = [r["n"] for r in items.select(n_words.alias("n")).filter((F.col("n") >= least) & (F.col("n") > 0)).distinct().collect()]  # 13 at most
    masks = masks_for(lengths)

    def seeds(batches, key):
        hasher = WordHasher()
        for rows, data, bounds in text_slices(batches, budget=1 << 20):
            ids = rows.column(rows.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            starts, ends, ptr = word_spans(data, bounds)
            h = hasher(data, starts, ends)
            seed, own, at = [], [], []
            for i, (a, b) in enumerate(zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)):
                part = h[a:b]
                if key == "item_id" and len(part) < max(1, least):
                    continue
                for mask in masks if key == "doc_id" else masks_of(len(part)):
                    s = seed_hashes(part, mask)
                    seed.append(s)
                    own.append(np.full(len(s), i))
                    at.append(np.arange(len(s)))
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(seed).astype(np.uint64).view(np.int64)), pa.array(ids[cat(own).astype(np.int64)].astype(np.int64)), pa.array(cat(at).astype(np.int64))], names=["seed", key, "at"])

    d = docs.mapInArrow(lambda b: seeds(b, "doc_id"), "seed long, doc_id long, at long")
    i = items.mapInArrow(lambda b: seeds(b, "item_id"), "seed long, item_id long, at long")
    tries = d.join(i.withColumnRenamed("at", "place"), "seed").groupBy("doc_id", "item_id").agg(F.collect_set(F.col("at") - F.col("place")).alias("offsets"))
    pairs = tries.join(items.withColumnRenamed("text", "item_text"), "item_id").join(docs, "doc_id")

    def verify(batches):
        hasher = WordHasher()

        def words(text):
            data = np.frombuffer(text.encode(), np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data)]))
            return hasher(data, starts, ends)

        for batch in batches:
            found = []
            for doc_id, item_id, offsets, item, doc in zip(*(batch.column(c) for c in range(5)), strict=True):
                d, i = words(doc.as_py()), words(item.as_py())
                for offset in offsets.as_py():
                    found += _judge((doc_id.as_py(), item_id.as_py()), d, i, offset, least, overlap, tolerance)
            yield _rows(found)

    return pairs.select("doc_id", "item_id", "offsets", "item_text", "text").mapInArrow(verify, SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that overlap with no benchmark item; all columns stay."""
    leak = fresh("leak")
    found = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(found, F.col("doc_id").cast("long") == F.col(leak), "left_anti")
