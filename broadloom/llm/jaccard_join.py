"""N-gram Jaccard join with count-vector R-trees.

A document is its set of distinct 5-word shingles, hashed to 64 bits. Hashes fall into
groups, and the numbers of hashes in the groups are a point; the sum of coordinate minima of
two points bounds the overlap of their sets from above. R-trees over these points find the
pairs that the bound lets through, and the sets themselves are compared for those.

One tree over the whole corpus would have to visit most of it for every query, as points of
unrelated documents lie close in so many dimensions. So there is a forest: documents meet in
a tree only under a shingle that both hold among their rarest (a set of n shingles takes part
under its n - ceil(0.75 n) + 1 rarest; two sets that link always share one of these). Rarity
is read from a table of 2**18 hash bins counted over all documents, so a passage that a third
of the documents hold comes last in each of them and is never where they meet. See linkage.py
for groups of copies.

Defined cases: a null or empty text, or one without words, has n_shingles 0 and its own id as
component; a text of fewer than 5 words has its whole word sequence as its one shingle; equal
sets link; rows that repeat a doc_id return once each with the id's component, as all texts
of one id hang together; a null doc_id takes no part and returns a null component. Empty
tables give an empty result. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.linkage import dealt_records, linked_classes, member_blocks, packed_vector, part_count, size_class
from broadloom.llm.shared import STRIPS, count_strips, fresh, materialize, summed_counts, texts
from broadloom.llm.tokens import U, WordHasher, mix, shingle_sets, text_slices, word_spans
from broadloom.operators.graph import components

BINS = 1 << 18


def _sets(batches, k: int):
    hasher = WordHasher()
    for rows, data, bounds in text_slices(batches):
        starts, ends, ptr = word_spans(data, bounds)
        yield rows, shingle_sets(hasher(data, starts, ends, lower=True), ptr, k)


def set_name(items: np.ndarray) -> int:
    """The node of a set: equal sets have one name."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(items + U(11)).sum() + U(len(items))], np.uint64)).view(np.int64)[0])


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, node, strip, part): a row per document, and rows (strip, part) that count
    the shingles of one task by bin."""
    schema = "doc_id long, n long, node long, vector binary, strip int, part binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        bins = np.zeros(BINS, np.int64)
        for rows, sets in _sets(batches, k):
            if sets:
                bins += np.bincount((np.concatenate(sets) >> U(46)).astype(np.int64), minlength=BINS)
            n = len(sets)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_name(s) if len(s) else None for s in sets], pa.int64()), pa.array([packed_vector(s) for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.nulls(STRIPS, pa.int64())] * 3 + [pa.nulls(STRIPS, pa.binary()), *count_strips(bins)], names=names)

    return materialize(texts(docs).mapInArrow(run, schema))


def bin_counts(table: DataFrame) -> np.ndarray:
    """Shingles of the corpus in each bin: a table of fixed size."""
    found = summed_counts(table.filter("strip IS NOT NULL"))
    return found if len(found) else np.zeros(BINS, np.int64)


def rarest(items: np.ndarray, bins: np.ndarray, num: int, den: int) -> np.ndarray:
    """The shingles under which a set takes part, rarest first by (bin count, hash)."""
    n = len(items)
    take = n - -(-num * n // den) + 1
    return items[np.lexsort((items, bins[(items >> U(46)).astype(np.int64)]))[:take]]


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per row: documents link when
    den * |A and B| >= num * |A or B|; component_id is the smallest doc_id reachable."""
    table = set_table(docs, k)
    bins = docs.sparkSession.sparkContext.broadcast(bin_counts(table).astype(np.uint32))
    rows = table.filter("strip IS NULL").select("doc_id", "n", "node", "vector")
    known = rows.filter("doc_id IS NOT NULL AND node IS NOT NULL")

    def keys(batches):
        for _, sets in _sets(batches, k):
            full = [s for s in sets if len(s)]
            parts = [rarest(s, bins.value, num, den) for s in full]
            each = [len(p) for p in parts]
            key = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            cls = np.repeat(np.array([size_class(len(s)) for s in full], np.int64), each)
            node = np.repeat(np.array([set_name(s) for s in full], np.int64), each)
            yield dealt_records(key, cls, node, parts_)

    records = known.agg(F.coalesce(F.sum(F.floor(F.col("n") * (den - num) / den) + 1), F.lit(0)).cast("long")).first()[0]
    parts_ = part_count(docs.sparkSession, records)
    records = texts(docs).filter("doc_id IS NOT NULL").mapInArrow(keys, "part int, blob binary")
    blocks = member_blocks(records, num, den, parts_)

    def payload(batches):
        for rows_, sets in _sets(batches, k):
            node = rows_.column(rows_.schema.get_field_index("node"))
            # a doc_id may stand for several texts; only the one of this node counts
            keep = [i for i, (s, x) in enumerate(zip(sets, node.to_pylist(), strict=True)) if len(s) and set_name(s) == x]
            yield pa.RecordBatch.from_arrays([node.take(pa.array(keep, pa.int64())), pa.array([sets[i].astype("<u8").tobytes() for i in keep], pa.binary())], names=["node", "items"])

    # a set is read from the smallest document that has it
    homes = materialize(known.join(blocks.select("node").distinct(), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("vector").alias("vector")))

    def fetch(nodes: DataFrame, more: bool = False) -> DataFrame:
        one = materialize(homes.select("node", "doc_id").join(nodes, "node"))
        # later fetches ask for few; Spark sees the size of their table and broadcasts it if small;
        # equal rows of one id give the set once
        chosen = texts(docs).join(one if more else one.hint("shuffle_hash"), "doc_id").dropDuplicates(["doc_id", "node", "text"])
        return materialize(chosen.select("node", "text").mapInArrow(payload, "node long, items binary"))

    classes = linked_classes(blocks, fetch, num, den, points=homes.select("node", "vector"))

    # from nodes to documents: a class takes its smallest doc_id; ids with several texts tie classes together
    joined = known.join(classes, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"))
    least = joined.groupBy("c").agg(F.min("doc_id").alias("least"))
    seen = joined.join(least, "c").select("doc_id", "least")
    ids = materialize(seen.groupBy("doc_id").agg(F.min("least").alias("least"), F.max("least").alias("other")))
    if not ids.filter("least <> other").isEmpty():
        ties = seen.join(ids.select("doc_id", F.col("least").alias("other")), "doc_id").select("least", "other")
        top = components(ties).withColumnRenamed("node", "least")
        ids = ids.join(top, "least", "left").select("doc_id", F.coalesce("component", "least").alias("least"))
    return rows.join(ids.select("doc_id", "least"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents whose id is the smallest of their component; all columns stay. Of rows
    that repeat such an id one stays. A null doc_id stays."""
    gone = fresh("gone")
    found = jaccard_components(docs, **options).filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    kept = docs.join(found, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    return kept.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id IS NULL"))
