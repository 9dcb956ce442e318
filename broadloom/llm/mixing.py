"""Mixing sources to target weights.

Each source's documents are laid end to end as one token stream and cut into fixed-length
blocks. Output slots are dealt in shards: every shard draws its multinomial source counts,
then a second pass moves surplus slots to sources below their quota, so that totals are met
exactly. The i-th slot of a source reads block ``permutation(i mod blocks)`` of that source:
a keyed bijection, so one epoch reads each block once before any is read again. Slots join
blocks by (source, block index).

Nothing is gathered per source: stream offsets come from sums over hash buckets of bounded
size, so a source with a third of all rows is spread like any other.

Defined cases: null or word-free text has size 0 and takes nothing; a null source is one
source of its own, ordered last; rows that repeat a doc_id each count and are laid in the
order of their text; a null doc_id is an ordinary row. An empty table gives an empty result.
Columns other than doc_id, text and source are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadloom.llm.shared import fresh, materialize
from broadloom.llm.tokens import mix

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text, counted as the places where one begins: two byte-wise replacements
    and no array of words. Null: 0."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.regexp_replace(marked, r"[\x20\x09-\x0D]+", "")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights: list[float], share: float, most: float) -> dict[str | None, float]:
    """Target of each source: ``share`` of all sizes dealt by weight (sources by code point,
    null last, weights repeating), none above ``most`` times its size; the excess is dealt
    again by weight among the rest until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    weight = {s: float(weights[i % len(weights)]) for i, (s, _) in enumerate(order)}
    limit = {s: most * n for s, n in order}
    left, open_, out = share * sum(n for _, n in order), [s for s, _ in order], {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > limit[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = limit[s]
        left -= sum(limit[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def mix_blocks(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, shard_slots: int = 16384, seed: int = 17, rows_per_bucket: int = 50_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as (pieces, slots, sources).

    pieces: a row for each document and block it reaches into, with ``words`` (of it in that
    block) and ``takes`` (how many slots read the block). slots: shard, slot, source id,
    block index. sources: sid, source, source_size, target. The number of sources must be
    modest (a table of them is kept on the driver); everything else is distributed.
    """
    spark = docs.sparkSession
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")))
    per_source = [(r["source"], r["n"] or 0, r["c"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("c")).collect()]
    goal = targets([(s, n) for s, n, _ in per_source], list(weights), share, most)
    order = sorted(per_source, key=lambda x: (x[0] is None, [ord(c) for c in x[0] or ""]))
    blocks = [-(-n // block) for _, n, _ in order]
    quota = [min(round(goal[s] / block) if n % block == 0 else round(goal[s] * b / n) if n else 0, int(most * b)) for (s, n, _), b in zip(order, blocks, strict=True)]
    rows = sum(c for _, _, c in order)
    buckets = max(1, -(-rows // rows_per_bucket))
    sources = spark.createDataFrame([(i, s, n, float(goal[s]), b) for i, ((s, n, _), b) in enumerate(zip(order, blocks, strict=True))], "sid int, source string, source_size long, target double, blocks long")

    # offsets: sums of (source, bucket), then of documents within a bucket
    laid = sized.join(F.broadcast(sources.select("sid", F.col("source").alias("s"))), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    laid = laid.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    sums = laid.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    base = sums.select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.join(base, ["sid", "bucket"]).withColumn("at", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    reach = laid.filter("size > 0").select("doc_id", "tie", "size", "sid", "at", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))).alias("block"))
    reach = reach.withColumn("words", F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block))

    # slots
    wanted = sum(quota)
    shards = -(-wanted // shard_slots) if wanted else 0
    share_of = np.array(quota, dtype=float) / max(1, wanted)

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = min(shard_slots, wanted - shard * shard_slots)
                counts = np.random.default_rng([seed, shard]).multinomial(n, share_of)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), shard), pa.int64()), pa.array(np.arange(len(counts)), pa.int32()), pa.array(counts, pa.int64())], names=["shard", "sid", "n"])

    drawn = spark.range(shards).mapInArrow(draw, "shard long, sid int, n long")
    quotas = spark.createDataFrame([(i, int(q)) for i, q in enumerate(quota)], "sid int, quota long")
    slots = _meet(drawn, quotas)
    slots = _indexed(slots.select("shard", F.col("sid").cast("int").alias("sid"), F.col("i").cast("long").alias("i"), F.col("slot").cast("int").alias("slot")), blocks, seed)
    # a plan made of a range looks tiny to the planner, which would broadcast every slot
    taken = slots.groupBy("sid", "block").agg(F.count("*").alias("takes"))
    pieces = reach.join(taken.hint("merge"), ["sid", "block"], "left").select("doc_id", "tie", "sid", "block", "at", "words", F.coalesce("takes", F.lit(0)).alias("takes"))
    return pieces, slots.select("shard", "slot", "sid", "block"), sources


def _meet(drawn: DataFrame, quotas: DataFrame) -> DataFrame:
    """One row per slot (shard, slot, sid, i), i counting a source's slots from 0; slots that
    a source drew beyond its quota pass, in order, to the sources that drew too few."""
    # (shard, source) counts are few; cumulative sums run per source over shards
    run = Window.partitionBy("sid").orderBy("shard")
    cum = drawn.withColumn("before", F.sum("n").over(run) - F.col("n")).join(F.broadcast(quotas), "sid")
    kept = F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("before")))
    cum = materialize(cum.withColumn("kept", kept))
    own = cum.filter("kept > 0").select("shard", "sid", F.explode(F.sequence(F.lit(0), F.col("kept") - 1)).alias("j"), "before").select("shard", "sid", (F.col("before") + F.col("j")).alias("i"))
    total = cum.groupBy("sid", "quota").agg(F.sum("kept").alias("got"))
    short = quotas.join(total.select("sid", "got"), "sid", "left").select("sid", "quota", F.coalesce("got", F.lit(0)).alias("got")).withColumn("lack", F.col("quota") - F.col("got"))
    need = short.filter("lack > 0").withColumn("to", F.sum("lack").over(Window.orderBy("sid")))  # a row per source
    spare = cum.groupBy("shard").agg(F.sum(F.col("n") - F.col("kept")).alias("spare")).filter("spare > 0")
    spare = spare.withColumn("until", F.sum("spare").over(Window.orderBy("shard")))  # a row per shard
    moved = spare.select("shard", F.explode(F.sequence(F.col("until") - F.col("spare"), F.col("until") - 1)).alias("k"))
    given = moved.join(F.broadcast(need), (F.col("k") < F.col("to")) & (F.col("k") >= F.col("to") - F.col("lack")))
    given = given.select("shard", "sid", (F.col("got") + F.col("k") - F.col("to") + F.col("lack")).alias("i"))
    every = own.select("shard", "sid", "i").union(given)
    return every.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64("sid", "i", F.lit(3)), "sid", "i")) - 1)


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed bijection of 0..n-1: a four-round Feistel network on the next even power of
    two, walked until it lands below n (fewer than four steps on average)."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out, todo = x.astype(np.uint64), np.ones(len(x), bool)
    while todo.any():
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            left, right = right, left ^ (mix(right + np.uint64((key * 0x9E3779B1 + r * 0x85EBCA6B) & (1 << 63) - 1)) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo &= out >= np.uint64(n)
    return out.astype(np.int64)


def _indexed(slots: DataFrame, blocks: list[int], seed: int) -> DataFrame:
    """Adds the block index that each slot reads."""

    def index(batches):
        import pyarrow as pa

        for batch in batches:
            sid, i = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("sid", "i"))
            out = np.zeros(len(i), np.int64)
            for s in np.unique(sid):
                n, own = blocks[s], np.flatnonzero(sid == s)
                for epoch in np.unique(i[own] // n):
                    part = own[i[own] // n == epoch]
                    out[part] = permuted(i[part] % n, n, seed * 1_000_003 + int(s) * 1009 + int(epoch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "block"])

    return slots.mapInArrow(index, "shard long, sid int, i long, slot int, block long")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """A row for each input row: doc_id, size, source_size, target, taken (words that the mix
    reads from it, repeats counted)."""
    pieces, _, sources = mix_blocks(docs, **options)
    taken = pieces.groupBy("doc_id", "tie", "at", "sid").agg(F.sum(F.col("words") * F.col("takes")).alias("taken"), F.sum("words").alias("size"))
    empty = docs.filter(word_count(F.col("text")) == 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("taken"))
    named = F.broadcast(sources.select("sid", F.col("source").alias("s"), "source_size", "target"))
    full = taken.join(named, "sid").select("doc_id", F.col("size").cast("long").alias("size"), "source_size", "target", F.col("taken").cast("long").alias("taken"))
    none = empty.join(named, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", "taken")
    return full.unionByName(none)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: the input's columns, one row for each document that the mix
    reads, with ``mix_words`` (words read, repeats counted; replaces a column of that name).
    Documents without words, and those whose blocks no slot reads, are not in the mix.
    Repeated rows of one doc_id and text share their words evenly in order, so each gets the
    sum of its copies."""
    own_id, own_tie = fresh("id"), fresh("tie")
    pieces, _, _ = mix_blocks(docs, **options)
    taken = pieces.groupBy(F.col("doc_id").alias(own_id), F.col("tie").alias(own_tie)).agg(F.sum(F.col("words") * F.col("takes")).alias("mix_words")).filter("mix_words > 0")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(own_tie))
    return docs.drop("mix_words").join(taken, same).drop(own_id, own_tie)
