"""From blocks of possibly similar sets to linked classes, losing no link and expanding no
group of copies into pairs.

Two sets may be linked only if they meet under a common key. A group of n copies meets under
every key, so testing all its pairs would cost its square. Instead, each member of a block is
first tested against the block's pivot; the links found make components. Then only blocks
that still hold members of different components are searched, across components, in pieces
of bounded size: first for the likeliest pairs, at most one a member, whose links close most
blocks, then for all pairs of what is still apart. A pair that is never tested lies in one
component already or cannot overlap enough, so components are the same as if every pair had
been tested.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.llm.shared import materialize, shuffle_width
from broadloom.llm.tokens import U, mix
from broadloom.operators.graph import components

#: A block with more members than this is never held as one; its members stream by.
LARGE = 4096
#: Records of a part that are held before the large blocks among them are let go.
HELD = 1 << 21
RECORD = np.dtype([("key", "<i8"), ("node", "<i8"), ("cls", "<i4")])
#: Size classes an octave.
OCTAVE = 8


def size_class(n: int) -> int:
    return int(np.log2(n) * OCTAVE)


def class_reach(num: int, den: int) -> int:
    """Sets whose classes differ by more are too unlike in size: log2(den / num) octaves, and
    one class for the rounding."""
    return int(np.log2(den / num) * OCTAVE) + 1


def dealt_records(key: np.ndarray, cls, node: np.ndarray, parts: int) -> pa.RecordBatch:
    """Records as (part, blob): the leading bits of a mixed key name its part, and the records
    of a part are one value, so Spark moves few rows."""
    part = ((mix(key.view(np.uint64)) >> U(32)) * U(parts) >> U(32)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    full = np.zeros(len(key), RECORD)
    full["key"], full["node"], full["cls"] = key, node, cls
    full, part = full[order], part[order]
    head = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    blobs = [full[a:b].tobytes() for a, b in zip(head.tolist(), [*head[1:].tolist(), len(part)], strict=True)] if len(head) else []
    return pa.RecordBatch.from_arrays([pa.array(part[head], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])


def _blocks(batches, reach: int):
    """(block, node, pivot) of every key with two nodes or more of like size; input
    (part, blob) sorted by part.

    A key's nodes fall apart where sizes leave a gap. A block's name is the hash of its
    member set, so the many keys that two copies share give one block; a very large one is
    named by its key, and its members pass as they come. The pivot is the first node of the
    own size bracket."""
    large: dict[int, dict[int, int]] = {}  # keys of large blocks: pivots by size bracket

    def batch(block, node, pivot):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (block, node, pivot)], names=["block", "node", "pivot"])

    def rows(keys, cls, nodes):
        cut = np.append(True, (keys[1:] != keys[:-1]) | (cls[1:] - cls[:-1] > reach))
        head = np.flatnonzero(cut)
        size = np.diff(np.append(head, len(keys)))
        name = np.add.reduceat(mix(nodes.view(np.uint64)), head).view(np.int64)
        chosen = np.zeros(len(head), bool)
        chosen[np.unique(name, return_index=True)[1]] = True
        member = np.repeat(chosen & (size > 1), size)
        bracket = np.append(True, cut[1:] | (cls[1:] // reach != cls[:-1] // reach))
        pivot = nodes[np.maximum.accumulate(np.where(bracket, np.arange(len(nodes)), 0))]
        return batch(np.repeat(name, size)[member], nodes[member], pivot[member])

    def streamed(got):
        for key in np.unique(got["key"]).tolist():
            name = int(mix(np.array([key], np.int64).view(np.uint64)).view(np.int64)[0])
            own = np.unique(got[got["key"] == key])
            level, pivots = own["cls"].astype(np.int64) // reach, large[key]
            for b, i in zip(*np.unique(level, return_index=True), strict=True):
                pivots.setdefault(int(b), int(own["node"][i]))
            yield batch(np.full(len(own), name), own["node"], np.array([pivots[b] for b in level.tolist()], np.int64))

    def met(got):
        """Records whose key others have too, sorted, each once."""
        order = np.argsort(got["key"])
        keys = got["key"][order]
        same = keys[1:] == keys[:-1]
        got = got[order[np.append(same, False) | np.append(False, same)]]
        got = got[np.lexsort((got["node"], got["cls"], got["key"]))]
        return got[np.append(True, got[1:] != got[:-1])] if len(got) else got

    def solved(held):
        got = met(np.concatenate(held)) if held else np.zeros(0, RECORD)
        if len(got):
            yield rows(got["key"], got["cls"].astype(np.int64), got["node"])

    def let_go(held):
        """Sends the members of large blocks on; returns the other records."""
        got = np.unique(np.concatenate(held))
        key, n = np.unique(got["key"], return_counts=True)
        found = key[n > LARGE]
        large.update((k, {}) for k in found.tolist())
        gone = np.isin(got["key"], found)
        return got[gone], got[~gone]

    now, held, n, most = None, [], 0, HELD
    for got in batches:
        for part, blob in zip(got.column(0).to_pylist(), got.column(1), strict=True):
            if part != now:
                yield from solved(held)
                now, held, n, most = part, [], 0, HELD
                large.clear()
            records = np.frombuffer(blob.as_buffer(), RECORD)
            if large:
                passing = np.isin(records["key"], np.array(list(large), np.int64))
                yield from streamed(records[passing])
                records = records[~passing]
            held.append(records)
            n += len(records)
            if n > most:
                passing, rest = let_go(held)
                yield from streamed(passing)
                held, n = [rest], len(rest)
                most = max(HELD, 2 * n)
    yield from solved(held)


def part_count(spark, records: int) -> int:
    """Parts for ``dealt_records``: a few for each shuffle partition, and so many that an
    average part has a quarter of the records that are held at once."""
    return max(8 * shuffle_width(spark), -(-4 * records // HELD))


def member_blocks(records: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """(block, node, pivot) from the rows (part, blob) of ``dealt_records``: long keys and
    nodes, cls the ``size_class`` of the node; repeats allowed."""
    tasks = max(shuffle_width(records.sparkSession), parts // 8)
    dealt = records.repartition(tasks, "part").sortWithinPartitions("part")
    return materialize(dealt.mapInArrow(lambda it: _blocks(it, class_reach(num, den)), "block long, node long, pivot long").distinct())


GROUPS = 64


def count_vector(items: np.ndarray, bits: int = 6) -> np.ndarray:
    """How many of a set's hashes fall in each of 2**bits groups: a point in count space."""
    return np.bincount((items >> U(64 - bits)).astype(np.int64), minlength=1 << bits)


def packed_vector(items: np.ndarray) -> bytes:
    """A point with one hash a group or fewer on average. Two sets of which a share is common
    then fall apart in the rest of their groups, so the bound lies close to the overlap.
    Groups are leading bits, so neighbours add up to a coarser point."""
    bits = min(20, max(6, int(np.log2(2 * max(1, len(items))))))
    while (v := count_vector(items, bits)).max(initial=0) >= 1 << 8:
        bits += 1
    return zlib.compress(v.astype(np.uint8).tobytes(), 1)  # most counts are 0 or 1


def unpacked_vector(raw) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.uint8)


def folded(v: np.ndarray, groups: int) -> np.ndarray:
    """The point in fewer groups."""
    return v.reshape(groups, -1).sum(1, dtype=np.int64) if len(v) > groups else v


def vector_bound(a: np.ndarray, b: np.ndarray) -> int:
    """The sum of coordinate minima, in the coarser point's groups."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum(dtype=np.int64))


class PointTable:
    """The points of a piece by their number of groups, and those of more groups folded to
    each number that others have, so that a point meets many at once."""

    def __init__(self, points: list[np.ndarray]) -> None:
        self.points = points
        self.groups = np.array([len(p) for p in points])
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for g in sorted(set(self.groups.tolist())):
            rows = np.flatnonzero((self.groups >= g) & (self.groups <= 2 * g))
            place = np.full(len(points), -1)
            place[rows] = np.arange(len(rows))
            self.tables[g] = place, np.stack([folded(points[i], g).astype(np.uint16) for i in rows.tolist()])

    def bounds(self, x: int, near: np.ndarray) -> np.ndarray:
        out = np.zeros(len(near), np.int64)
        level = np.minimum(self.groups[near], self.groups[x])
        for g in np.unique(level).tolist():
            chosen = np.flatnonzero(level == g)
            place, table = self.tables[g]
            at = place[near[chosen]]
            if place[x] >= 0 and (at >= 0).all():
                out[chosen] = np.minimum(table[place[x]], table[at]).sum(1, dtype=np.int64)
            else:  # unlike in size by more than the double: never linked at usual thresholds
                out[chosen] = [vector_bound(self.points[x], self.points[y]) for y in near[chosen].tolist()]
        return out


def enough(shared, a, b, num: int, den: int):
    """den * |A and B| >= num * |A or B|"""
    return (den + num) * shared >= num * (a + b)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two arrays, each without repeats."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


class CountTree:
    """An R-tree over count vectors, bulk-loaded by size slabs. A node keeps the largest
    coordinates below it and its smallest size; the sum of coordinate minima with a query
    bounds every overlap below the node from above."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, fan: int = 8) -> None:
        lead = np.argsort(vectors.sum(0))[-1] if len(vectors) else 0
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // max(1, fan * fan)
        self.order = np.lexsort((vectors[:, lead], slab))
        self.fan, top, low = fan, vectors[self.order], sizes[self.order]
        self.levels = [(top, low)]
        while len(top) > 1:
            head = np.arange(0, len(top), fan)
            top, low = np.maximum.reduceat(top, head), np.minimum.reduceat(low, head)
            self.levels.append((top, low))

    def search(self, vector: np.ndarray, size: int, num: int, den: int) -> np.ndarray:
        """Points whose bound is enough for a link with the query."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low = self.levels[depth]
            bound = np.minimum(vector, top[at]).sum(1)
            at = at[enough(bound, size, low[at], num, den)]
            if depth:
                at = (at[:, None] * self.fan + np.arange(self.fan)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def as_hashes(items) -> np.ndarray:
    return np.frombuffer(items, "<u8")


def _bounded(batches, num: int, den: int):
    """Pairs that the sum of coordinate minima of their count vectors lets through, with its
    share of the larger set."""
    for batch in batches:
        share, keep = [], []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            a, b = unpacked_vector(a.as_buffer()), unpacked_vector(b.as_buffer())
            bound, n, m = vector_bound(a, b), a.sum(dtype=np.int64), b.sum(dtype=np.int64)
            keep.append(bool(enough(bound, n, m, num, den)))
            share.append(bound / max(n, m, 1))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([*batch.filter(keep).columns[:2], pa.array(share, pa.float64()).filter(keep)], names=["pivot", "node", "share"])


def hash_overlaps(left, right) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common elements and sizes of pairs of sets, given as 64-bit hashes."""
    raw = a = None  # the left set stays the same for a while
    out = []
    for x, y in zip(left, right, strict=True):
        x = x.as_buffer()
        if raw is None or not raw.equals(x):
            raw, a = x, as_hashes(x)
        b = as_hashes(y.as_buffer())
        out.append((overlap(a, b), len(a), len(b)))
    shared, n, m = np.array(out, np.int64).reshape(-1, 3).T
    return shared, n, m


def _verified(batches, num: int, den: int, overlaps):
    """Pairs of sets with enough in common."""
    for batch in batches:
        shared, n, m = overlaps(batch.column(2), batch.column(3))
        chosen = batch.filter(pa.array(enough(shared, n, m, num, den), pa.bool_()))
        yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], names=["u", "v"])


def _pieces(batches):
    """(chunks, nodes, components, payloads) of each piece; input sorted by piece, with the
    columns block, i, j, chunk, node, c, payload."""
    now, members = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(6)]
        for *piece, chunk, node, c, payload in zip(*columns, batch.column(6), strict=True):
            if piece != now:
                if len(members) > 1:
                    yield zip(*members, strict=True)
                now, members = piece, []
            members.append((chunk, node, c, payload.as_py()))
    if len(members) > 1:
        yield zip(*members, strict=True)


def _pairs(found: list[tuple[int, int]], names=("u", "v")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=list(names))


def _tree_pairs(batches, num: int, den: int, likeliest: bool):
    """Pairs of different components that an R-tree of each piece lets through; ``likeliest``:
    for each member only the one with the highest bound, and none with a component that it
    has been paired with already. In a piece of two chunks only pairs across them count; the
    others are in a piece of their own."""
    for chunk, node, comp, payload in _pieces(batches):
        fine = [unpacked_vector(p) for p in payload]
        coarse, table = np.stack([folded(v, GROUPS).astype(np.int64) for v in fine]), PointTable(fine)
        sizes, chunk, node, comp = coarse.sum(1), np.array(chunk), np.array(node), np.unique(np.array(comp), return_inverse=True)[1]
        tree, across, found = CountTree(coarse, sizes), len(set(chunk.tolist())) > 1, []
        for x in range(len(node)):
            near = tree.search(coarse[x], sizes[x], num, den)
            near = near[comp[near] != comp[x]]
            if across:
                near = near[chunk[near] != chunk[x]]
            if not likeliest:
                near = near[node[near] > node[x]]
            if not len(near):
                continue
            bounds = table.bounds(x, near)
            passing = enough(bounds, sizes[x], sizes[near], num, den)
            near, bounds = near[passing], bounds[passing]
            if likeliest and len(near):
                y = near[np.lexsort((node[near], bounds / np.maximum(sizes[x], sizes[near])))[-1]]
                comp[comp == comp[y]] = comp[x]
                found.append((min(node[x], node[y]), max(node[x], node[y])))
            elif len(near):
                found += [(node[x], other) for other in node[near].tolist()]
        yield _pairs(found, ("pivot", "node"))


def _links_across(batches, num: int, den: int, decode, at_once: int = 1024, most_bytes: int = 4 << 20):
    """Links between different components of each piece, the sets compared in place; a
    component that has found its link is not searched again. Sets of many small pieces are
    decoded together."""

    def solved(held):
        sets, found = iter(decode([p for *_, payload in held for p in payload])), []
        for chunk, node, comp, payload in held:
            found += _piece_links(chunk, node, comp, [next(sets) for _ in payload], num, den)
        return _pairs(found)

    held, n, size = [], 0, 0
    for piece in _pieces(batches):
        held.append(tuple(piece))
        n += len(held[-1][1])
        size += sum(len(p) for p in held[-1][3])
        if n >= at_once or size >= most_bytes:
            yield solved(held)
            held, n, size = [], 0, 0
    if held:
        yield solved(held)


def _piece_links(chunk, node, comp, sets, num: int, den: int) -> list[tuple[int, int]]:
    across, found = len(set(chunk)) > 1, []
    if len(sets) <= 8:  # most pieces: too few for arrays to pay
        comp, sizes = list(comp), [len(s) for s in sets]
        for x in range(len(sets)):
            for y in range(x):
                if comp[x] == comp[y] or across and chunk[x] == chunk[y] or not enough(min(sizes[x], sizes[y]), sizes[x], sizes[y], num, den):
                    continue
                if enough(overlap(sets[x], sets[y]), sizes[x], sizes[y], num, den):
                    old, new = comp[y], comp[x]
                    comp = [new if c == old else c for c in comp]
                    found.append((node[x], node[y]))
        return found
    sizes, chunk = np.array([len(s) for s in sets]), np.array(chunk)
    comp = np.unique(np.array(comp), return_inverse=True)[1]
    for x in np.argsort(sizes, kind="stable").tolist():
        near = np.flatnonzero(enough(np.minimum(sizes[x], sizes), sizes[x], sizes, num, den) & (comp != comp[x]) & ((chunk != chunk[x]) | (not across)))
        for y in near.tolist():
            if comp[y] != comp[x] and enough(overlap(sets[x], sets[y]), sizes[x], sizes[y], num, den):
                comp[comp == comp[y]] = comp[x]
                found.append((node[x], node[y]))
    return found


def chunk_pairs(rest: DataFrame, piece: int) -> DataFrame:
    """(block, i, j, chunk, node, c): the members of each piece, so that any two members of
    different components meet in one of their block. rest: block, node, c, k (chunks).

    The members of a large block's largest component have chunks of their own, which meet
    the other members' chunks only: a block of one large component and few others makes few
    more rows than it has members, however large the component is."""
    large = rest.filter("k > 1").groupBy("block", "c").agg(F.count("*").alias("_m"))
    large = large.groupBy("block").agg(F.max_by("c", F.struct("_m", "c")).alias("_top"), F.max("_m").alias("_m"), F.sum("_m").alias("_n"))
    chunks = lambda n: F.ceil(n / piece).cast("long")
    large = large.select("block", "_top", chunks(F.col("_m")).alias("_t"), chunks(F.col("_n") - F.col("_m")).alias("_r"))
    dealt = rest.select("block", "node", "c").join(large, "block", "left")
    top, hashed, zero = F.col("c") == F.col("_top"), F.xxhash64("node"), F.lit(0).cast("long")
    chunk = F.when(F.col("_top").isNull(), zero).when(top, F.pmod(hashed, F.col("_t"))).otherwise(F.col("_t") + F.pmod(hashed, F.col("_r")))
    first, last = F.when(top, F.col("_t")).otherwise(zero), F.coalesce(F.col("_t") + F.col("_r") - 1, zero)
    dealt = dealt.withColumn("chunk", chunk).withColumn("o", F.explode(F.sequence(first, last)))
    return dealt.select("block", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "node", "c")


def linked_classes(blocks: DataFrame, fetch, num: int, den: int, decode=None, overlaps=hash_overlaps, points: DataFrame | None = None, piece: int = 256) -> DataFrame:
    """(node, component) for every node with a link.

    blocks: (block, node, pivot). fetch: from a table of nodes to (node, items), items the
    bytes of the node's set (``more``: nodes beyond those of an earlier call); ``overlaps`` measures many pairs of such bytes at once.
    points: (node, vector), the count vectors of the nodes; with them bounds decide which
    pairs are worth their sets, and only those sets are fetched; without them sets are
    small enough to go where their blocks go, and ``decode`` turns a list of such bytes into
    arrays of distinct hashes.

    A node is first tested against its likeliest pivot, then, as far as their components
    differ, against its likeliest partner in each block, then against the rest of its blocks.
    """

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        mine = pairs.join(sets, "node").withColumnRenamed("items", "b")
        both = mine.join(sets.select(F.col("node").alias("pivot"), F.col("items").alias("a")), "pivot")
        return materialize(both.select("pivot", "node", "a", "b").mapInArrow(lambda it: _verified(it, num, den, overlaps), "u long, v long"))

    def classed(df: DataFrame, classes: DataFrame, node: str, out: str) -> DataFrame:
        named = classes.select(F.col("node").alias(node), F.col("component").alias("_c"))
        return df.join(named, node, "left").withColumn(out, F.coalesce("_c", node)).drop("_c")

    def nodes_of(pairs: DataFrame) -> DataFrame:
        return pairs.select("node").union(pairs.select("pivot")).distinct()

    def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``sets`` and those of the pairs' other nodes."""
        more = materialize(nodes_of(pairs).join(sets.select("node"), "node", "left_anti"))
        return sets if more.isEmpty() else sets.unionByName(fetch(more, more=True))

    stars = blocks.filter("node <> pivot").select("pivot", "node").distinct()
    if points is None:
        stars = stars.withColumn("share", F.lit(0.0))
    else:
        near = stars.join(points, "node").withColumnRenamed("vector", "b").join(points.select(F.col("node").alias("pivot"), F.col("vector").alias("a")), "pivot")
        stars = near.select("pivot", "node", "a", "b").mapInArrow(lambda it: _bounded(it, num, den), "pivot long, node long, share double")
    stars = materialize(stars)
    tested = materialize(stars.groupBy("node").agg(F.max_by("pivot", F.struct("share", -F.col("pivot"))).alias("pivot")).select("pivot", "node"))
    sets = fetch(materialize(nodes_of(stars if points is None else tested)))
    links = verified(tested, sets)
    classes = components(links)

    def apart_stars(classes: DataFrame, likeliest: bool) -> DataFrame:
        """Star pairs that are not tested and lie in different components; ``likeliest``: of
        two components' pairs the one with the highest bound."""
        left = stars.join(tested, ["pivot", "node"], "left_anti")
        left = classed(classed(left, classes, "node", "c"), classes, "pivot", "d").filter("c <> d")
        if likeliest:
            best = F.max(F.struct("share", "pivot", "node"))
            left = left.groupBy(F.least("c", "d"), F.greatest("c", "d")).agg(best.alias("best")).select("best.pivot", "best.node")
        return left.select("pivot", "node")

    def open_members(classes: DataFrame) -> DataFrame:
        # the pair of a block of two with one pivot is a star pair
        members = classed(blocks, classes, "node", "c")
        left = members.groupBy("block").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n"), (F.min("pivot") != F.max("pivot")).alias("mixed"))
        left = left.filter("lo <> hi AND (n > 2 OR mixed)").select("block", F.ceil(F.col("n") / piece).cast("long").alias("k"))
        return materialize(members.drop("pivot").join(left, "block").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("k"))))

    def pieces(dealt: DataFrame, payload: DataFrame) -> DataFrame:
        full = dealt.hint("merge").join(payload, "node").select("block", "i", "j", "chunk", "node", "c", payload.columns[1])
        return full.repartition(shuffle_width(blocks.sparkSession), "block", "i", "j").sortWithinPartitions("block", "i", "j")

    if points is None:
        links = links.union(verified(materialize(apart_stars(classes, False)), sets))
        classes = components(links)
        across = pieces(chunk_pairs(open_members(classes), piece), sets).mapInArrow(lambda it: _links_across(it, num, den, decode), "u long, v long")
        return components(links.union(across))
    rest = open_members(classes)
    for likeliest in (True, False):
        shared = pieces(rest.withColumns({"i": F.col("chunk"), "j": F.col("chunk")}) if likeliest else chunk_pairs(rest, piece), points)
        found = shared.mapInArrow(lambda it, first=likeliest: _tree_pairs(it, num, den, first), "pivot long, node long")
        known = tested.union(tested.select("node", "pivot"))
        pairs = apart_stars(classes, likeliest).union(found).distinct().join(known, ["pivot", "node"], "left_anti")
        pairs = materialize(pairs)
        if pairs.isEmpty():
            continue
        sets = with_sets(pairs, sets)
        links = links.union(verified(pairs, sets))
        tested = tested.union(pairs)
        classes = components(links)
        if likeliest:
            rest = open_members(classes)
    return classes
