"""Token counts of whole texts under a byte-level BPE vocabulary, without the library's encoder:
the vocabulary is compiled to finite-state machines (``token_machine``).

A slice of a megabyte of texts is one stream; the splitting machine finds all its pre-tokens by
chunk maps and a prefix scan, each distinct pre-token of the slice runs through the counting
machine, all side by side, and counts are summed by text. Nothing is shuffled; the vocabulary
(a file of fixed size) is broadcast, machines live in the worker. Strings of special tokens in
a text count as one token and part the text, as the library does by default.

Defined results: null and empty texts have no bytes and no tokens; very long texts are a slice
of their own, so memory follows the longest text; null doc_ids and repeated rows come back row
by row; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from broadloom.llm.shared import texts
from broadloom.llm.token_machine import Machine, Splitter, machine_of
from broadloom.llm.tokens import text_slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
SEPARATOR = 0x110000


def count_tokens(pieces: list[str], splitter: Splitter, machine: Machine) -> np.ndarray:
    """Tokens of each piece of text; none holds the string of a special token."""
    lengths = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(lengths + 1) - 1  # a separator stands after each piece
    codes = np.full(int(lengths.sum()) + len(pieces), SEPARATOR, np.int64)
    inside = np.ones(len(codes), bool)
    inside[ends] = False
    joined = "".join(pieces)
    codes[inside] = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kinds = splitter.kinds(codes)
    begins = splitter.borders(kinds)
    del kinds
    width = np.where(inside, 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), 0)
    place = np.concatenate([[0], np.cumsum(width)])  # byte before each code point
    starts = np.flatnonzero(begins & inside)
    bounds = np.append(place[starts], place[-1])  # pre-tokens follow each other without a gap
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(joined.encode())]).dictionary_encode()
    counts = machine.counts(words.dictionary)[np.asarray(words.indices)]
    total = np.concatenate([[0], np.cumsum(counts)])
    last = np.searchsorted(starts, ends)
    return np.diff(np.concatenate([[0], total[last]]))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit``) of every document.
    ``vocabulary``: path of a ``tokenizers`` file, read once on the driver."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, machine = machine_of(spec.value)
        for rows, data, bounds in text_slices(batches):
            raw = data.tobytes()
            pieces, owner, extra = [], [], np.zeros(len(bounds) - 1, np.int64)
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                text = raw[a:b].decode("utf-8", "replace")
                parts = machine.special.split(text) if machine.special else [text]
                extra[k] = len(parts) - 1
                pieces += parts
                owner += [k] * len(parts)
            n = extra + np.bincount(owner, weights=count_tokens(pieces, splitter, machine), minlength=len(extra)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(count, SCHEMA)
