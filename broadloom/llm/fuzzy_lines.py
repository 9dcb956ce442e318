"""Line dedup: fuzzy lines by MinHash.

A line is the set of its ``k``-character shingles (A-Z lower-cased). One-permutation MinHash
gives each distinct line ``bands * rows`` values from one pass over its shingles; lines that
agree on a whole band are candidates, candidates are compared by exact Jaccard, and a
distributed union-find makes classes, of which the earliest line stays.

With 12 bands of 4 values two lines of similarity 0.75 meet with probability 0.989, of 0.85
with 0.9998. Equal lines always meet: they are one node. See linkage.py for how a class of
thousands of lines is found without testing all its pairs.

Defined cases: lines are split at \\n alone; a line without words is never removed; a line
shorter than ``k`` characters is one shingle and so only equals itself; null and empty texts
have one empty line. The earliest line is that of the smallest doc_id, then the smaller text
hash (for rows that repeat a doc_id), then the smaller line number. Equal rows are one
document: all return, with the same lines kept. A row with a null doc_id stays whole. Empty
tables give an empty result. Columns other than doc_id and text are ignored, or kept by
``without_line_copies``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadloom.llm.linkage import dealt_records, linked_classes, member_blocks, part_count
from broadloom.llm.shared import fresh, materialize, texts
from broadloom.llm.tokens import U, WordHasher, byte_spans, mix, text_slices


def without_word(line) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r")) == ""


def line_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, number, line, node) of every line with a word; node is the line's hash."""
    rows = texts(docs).filter("doc_id IS NOT NULL")
    lines = rows.select("doc_id", F.xxhash64("text").alias("tie"), F.posexplode(F.split("text", "\n", -1)).alias("number", "line"))
    return lines.filter(~without_word(F.col("line"))).withColumn("node", F.xxhash64("line"))


def shingle_codes(hasher: WordHasher, points: np.ndarray, k: int) -> np.ndarray:
    """Code of each k consecutive code points."""
    if len(points) < k:
        return np.zeros(0, np.uint64)
    if len(points) > hasher.size:
        hasher.grow(len(points))
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * hasher.power[: len(points)], out=total[1:])
    codes = total[k:] - total[:-k]
    codes *= hasher.back[: len(points) - k + 1]
    codes ^= codes >> U(32)
    codes *= U(0xD6E8FEB86659FD93)
    codes ^= codes >> U(29)
    return codes


def joined_codes(values, k: int, hasher: WordHasher) -> np.ndarray:
    """The sorted distinct shingle codes of up to 4096 lines, each code's upper 12 bits
    replaced by the number of its line."""
    data, bounds = byte_spans(values)
    raw = data[bounds[0] : bounds[-1]].tobytes().lower()
    bounds = bounds - bounds[0]
    if not raw.isascii():
        at = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        points, bounds = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4"), at[bounds]
    else:
        points = np.frombuffer(raw, np.uint8)
    length = np.diff(bounds)
    n = np.maximum(0, length - k + 1)
    line = np.repeat(np.arange(len(n)), n)
    codes = shingle_codes(hasher, points, k)[np.arange(n.sum()) + np.repeat(bounds[:-1] - np.cumsum(n) + n, n)]
    short = np.flatnonzero((n == 0) & (length > 0))
    if len(short):
        own = [shingle_codes(hasher, points[bounds[i] : bounds[i + 1]], int(length[i]))[0] for i in short.tolist()]
        line, codes = np.append(line, short), np.append(codes, np.array(own, np.uint64))
    keys = line.astype(np.uint64) << U(52) | codes >> U(12)
    keys.sort()
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def line_sets(lines: list[bytes], k: int, hasher: WordHasher, budget: int = 1 << 19) -> list[np.ndarray]:
    """The sorted distinct shingle codes (52 bits) of each line, A-Z lower-cased."""
    total, sets, i = np.cumsum([len(x) for x in lines]), [], 0
    while i < len(lines):
        before = total[i - 1] if i else 0
        j = min(i + 4096, max(i + 1, int(np.searchsorted(total, before + budget, "right"))))
        keys = joined_codes(pa.array(lines[i:j], pa.binary()), k, hasher)
        cut = np.searchsorted(keys, np.arange(1, j - i, dtype=np.uint64) << U(52))
        sets += np.split(keys & U((1 << 52) - 1), cut)
        i = j
    return sets


def line_overlaps(left, right, k: int, hasher: WordHasher, budget: int = 1 << 19):
    """Common shingles and set sizes of pairs of lines, some thousands of pairs at a time."""
    total = np.cumsum(np.diff(byte_spans(left)[1]) + np.diff(byte_spans(right)[1]))
    out, i = [np.zeros((3, 0), np.int64)], 0
    while i < len(total):
        before = total[i - 1] if i else 0
        j = min(i + 4096, max(i + 1, int(np.searchsorted(total, before + budget, "right"))))
        a, b = (joined_codes(x.slice(i, j - i), k, hasher) for x in (left, right))
        both = np.concatenate([a, b])
        both.sort()
        both = both[1:][both[1:] == both[:-1]]
        out.append(np.stack([np.bincount((x >> U(52)).astype(np.int64), minlength=j - i) for x in (both, a, b)]))
        i = j
    return np.concatenate(out, axis=1)


def signatures(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int, size: int, hasher: WordHasher) -> np.ndarray:
    """One-permutation MinHash of lines, given as ascending byte spans of UTF-8 text: the
    least code in each of ``size`` bins. An empty bin takes the next full one's value, moved
    by the distance, so that lines that agree there agree here."""
    points = np.frombuffer(data.tobytes().lower().decode().encode("utf-32-le"), "<u4")
    at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)])  # byte to code point
    s, e = at[starts].astype(np.int64), at[ends].astype(np.int64)
    codes = shingle_codes(hasher, points, k)
    n = np.maximum(0, e - s - k + 1)
    # a code belongs to its line's row; those across lines, to one more row that is dropped
    long, spare = np.flatnonzero(n), len(s)
    step = np.zeros(len(codes) + 1, np.int64)
    step[s[long]] = long - spare
    step[(s + n)[long]] = spare - long
    row = np.cumsum(step[:-1]) + spare
    none = U(0xFFFFFFFFFFFFFFFF)
    table = np.full((len(s) + 1) * size, none)
    spot = (codes >> U(32)) * U(size) >> U(32)  # the bin uses the upper half, the order the lower
    np.minimum.at(table, row * size + spot.view(np.int64), codes << U(32) | codes >> U(32))
    for i in np.flatnonzero(n == 0).tolist():  # shorter than a shingle: the whole line is one
        code = int(shingle_codes(hasher, points[s[i] : e[i]], int(e[i] - s[i]))[0])
        table[i * size + ((code >> 32) * size >> 32)] = (code << 32 | code >> 32) & (1 << 64) - 1
    table = table[: len(s) * size]
    table = table.reshape(-1, size)
    full = np.where(table != none, np.arange(size), 2 * size)
    twice = np.concatenate([full, np.where(full < size, full + size, 4 * size)], axis=1)
    following = np.minimum.accumulate(twice[:, ::-1], axis=1)[:, ::-1][:, :size]
    values = np.take_along_axis(table, following % size, axis=1)
    return values + (following - np.arange(size)).astype(np.uint64) * U(0xD1342543DE82EF95)


def line_classes(docs: DataFrame, k: int = 8, num: int = 75, den: int = 100, bands: int = 12, rows: int = 4) -> DataFrame:
    """(node, component) of the lines that have a near copy."""
    lines = line_rows(docs)

    def keys(batches):
        hasher = WordHasher()
        for part, data, bounds in text_slices(batches, "line", budget=1 << 19):
            node, once = np.unique(part.column(0).to_numpy(), return_index=True)
            node, once = node[np.argsort(once)], np.sort(once)
            values = signatures(data, bounds[:-1][once], bounds[1:][once], k, bands * rows, hasher).reshape(len(node), bands, rows)
            key = np.zeros((len(node), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for r in range(rows):
                key = mix(key ^ values[:, :, r])
            # one size class: lines that agree on a band are alike in size as it is
            yield dealt_records(key.ravel().view(np.int64), 0, np.repeat(node, bands), parts)

    # parts have room for four times as many records: lines of 25 bytes on average
    parts = part_count(docs.sparkSession, bands * (texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 100)
    records = lines.select("node", "line").mapInArrow(keys, "part int, blob binary")
    blocks = member_blocks(records, num, den, parts)

    def fetch(nodes: DataFrame) -> DataFrame:
        # each task lets copies of a line go before they meet, so a common line is a row a task
        one = lines.select("node", F.col("line").cast("binary").alias("items")).dropDuplicates(["node"])
        return materialize(one.join(nodes.hint("shuffle_hash"), "node"))

    hasher: list[WordHasher] = []  # one for each task

    def own_hasher():
        if not hasher:
            hasher.append(WordHasher())
        return hasher[0]

    def decode(lines):
        return line_sets(lines, k, own_hasher())

    def overlaps(left, right):
        return line_overlaps(left, right, k, own_hasher())

    return linked_classes(blocks, fetch, num, den, decode=decode, overlaps=overlaps)


def kept_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, tie, kept): of the rows of that id and text hash, the numbers of the lines
    that are the first of their class. Lines with a word that are not among them are copies.

    Occurrences are aggregated by line, then by class, so a line in a third of all documents
    is one row of each task; no occurrence is joined with its class."""
    classes = line_classes(docs, **options)
    place = F.struct("doc_id", "tie", F.col("number").alias("line"))
    lines = line_rows(docs).select("node", place.alias("at")).groupBy("node").agg(F.min("at").alias("at"))
    lines = materialize(lines.join(classes, "node", "left").select("component", "at"))
    classed = lines.filter("component IS NOT NULL").groupBy("component").agg(F.min("at").alias("at"))
    first = lines.filter("component IS NULL").select("at").unionByName(classed.select("at"))
    return first.groupBy("at.doc_id", "at.tie").agg(F.collect_list("at.line").alias("kept"))


def without_line_copies(docs: DataFrame, **options) -> DataFrame:
    """All rows and columns, ``text`` without the lines that repeat an earlier one (near
    copies too), plus n_lines and n_removed (which replace columns of these names). n_chars,
    if there, follows the text."""
    own_id, own_tie, own_kept, parts = (fresh(c) for c in ("id", "tie", "kept", "parts"))
    kept = kept_lines(docs, **options).withColumnsRenamed({"doc_id": own_id, "tie": own_tie, "kept": own_kept})
    body = F.coalesce("text", F.lit(""))
    joined = docs.join(kept.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col(own_id)) & (F.xxhash64(body) == F.col(own_tie)), "left")
    joined = joined.withColumn(parts, F.split(body, "\n", -1))
    # the numbers of the lines that stay: first of their class, or without a word
    empty = F.filter(F.transform(parts, lambda x, i: F.when(without_word(x), i)), lambda i: i.isNotNull())
    stay = F.when(F.col("doc_id").isNull(), F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(F.concat(empty, F.coalesce(own_kept, F.array().cast("array<int>"))))
    joined = joined.withColumn(own_kept, stay)
    n, out = F.size(parts).cast("long"), joined
    gone = n - F.size(own_kept)
    text = F.transform(F.array(F.struct(F.col(parts).alias("all"), F.array_sort(own_kept).alias("stay"))), lambda s: F.transform(s["stay"], lambda i: F.get(s["all"], i)))
    out = out.withColumns({"text": F.when(gone == 0, F.col("text")).otherwise(F.array_join(text[0], "\n")), "n_lines": n, "n_removed": gone})
    out = out.drop(own_id, own_tie, own_kept, parts)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def line_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the kept text, UTF-8), a row per row."""
    out = without_line_copies(docs, **options)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
