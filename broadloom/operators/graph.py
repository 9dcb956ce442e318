"""Connected components of an edge table, all in DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadloom.sources.shared import materialize


#: Edges that one task contracts at once.
EDGES = 1 << 19


def smallest_members(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it hangs together with): larger roots hook to smaller ones and
    paths are halved until every edge lies within one root."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while ((up := root[root]) != root).any():
            root = up
    return nodes, nodes[root]


def _forest(batches, most: int):
    """Contracts at most ``most`` edges at a time: leaves one edge to the smallest member for
    every other member, so copies of a link go before the first shuffle."""

    def contracted(held):
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held] or [np.zeros(0, np.int64)]) for i in (0, 1))
        node, least = smallest_members(u, v)
        below = node != least
        return pa.RecordBatch.from_arrays([pa.array(node[below]), pa.array(least[below])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= most:
            yield contracted(held)
            held, n = [], 0
    yield contracted(held)


def _tasks(links: DataFrame, n: int) -> int:
    """Shuffle tasks of which none holds much more than ``EDGES`` of ``n`` links."""
    return max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // EDGES))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node.

    edges: two long columns, in any direction, repeats and loops allowed. Distributed
    union-find: pieces of bounded size are contracted by a local union-find, in so many tasks
    that each has about one piece, then large-star and small-star rounds hang every node
    below the smallest one it can see until nothing moves. A hub's neighbours are found by a
    partially aggregated minimum and a join that adaptive execution can split, never gathered
    in one group.
    """
    a, b = edges.columns[:2]
    links = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    links = materialize(links.mapInArrow(lambda it: _forest(it, EDGES // 4), "u long, v long"))
    n = links.count()
    pieces = links.coalesce(max(1, -(-n // EDGES)))
    # nodes that follow one another take few bytes, so tasks sized by bytes would hold too many
    links = materialize(pieces.mapInArrow(lambda it: _forest(it, 2 * EDGES), "u long, v long").repartition(_tasks(links, n), "u", "v").distinct())
    # every component is a star once no parent has a parent
    while not _stars(links):
        both = links.select("u", "v").union(links.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # below a node lie few others, so here both uses of a node's rows share one shuffle
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).repartition(_tasks(links, links.count()), "u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        links = materialize(hung.filter("u <> v").distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _stars(links: DataFrame) -> bool:
    """Has no node a parent and a child, or two parents?"""
    roles = links.select(F.col("u").alias("n"), F.lit(1).alias("r"), F.col("v").alias("p")).union(links.select("v", F.lit(2), F.lit(None).cast("long")))
    mixed = roles.groupBy("n").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.min("p").alias("p"), F.max("p").alias("q"))
    return mixed.filter("lo <> hi OR p <> q").isEmpty()
