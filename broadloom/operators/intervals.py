"""Interval, as-of and uniqueness joins.

Rows that may meet lie within a bounded time of each other, so time is cut into buckets as
wide as the reach: each row of one side goes to its bucket, each of the other to the one or
two buckets that its reach touches, and an equi join on (keys, bucket) does the rest. No side
is broadcast and no product of a key's rows is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(c: str | Column) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp")) / 1_000_000


def within(left: DataFrame, right: DataFrame, keys: list[str], lts: str, rts: str, low: float, high: float, how: str = "inner", extra: Column | None = None, closed: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Pairs with ``low <= rts - lts <= high`` seconds and equal keys.

    ``keys`` name columns of both sides; the right side's are dropped. ``closed`` says which
    ends belong to the interval. ``how`` may be inner, left_semi, left_anti. ``extra`` is a
    further condition over both sides' columns, which must have names of their own."""
    wide = max(1.0, high - low)
    bucket = lambda x: F.floor(x / wide)
    at = seconds(lts)
    a = left.withColumn("_t", at).withColumn("_b", F.explode(F.array_distinct(F.array(bucket(at + low), bucket(at + high)))))
    names = {k: f"_r_{k}" for k in keys}
    b = right.withColumnsRenamed(names).withColumn("_u", seconds(rts)).withColumn("_rb", bucket(seconds(rts)))
    gap = F.col("_u") - F.col("_t")
    on = (F.col("_b") == F.col("_rb")) & (gap >= low if closed[0] else gap > low) & (gap <= high if closed[1] else gap < high)
    for k in keys:
        on = on & (F.col(k) == F.col(names[k]))
    if extra is not None:
        on = on & extra
    if how == "inner":
        return a.join(b, on).drop("_t", "_b", "_u", "_rb", *names.values())
    # a left row may lie in two buckets, so ids of those that met are taken once
    raise_if = [c for c in ("_id",) if c not in left.columns]
    if raise_if:
        raise ValueError("semi and anti joins need a unique column _id on the left")
    met = a.join(b, on, "left_semi").select("_id").distinct()
    return left.join(met, "_id", how)


def nearest(pairs: DataFrame, left_id: str, gap: Column, tie: str) -> DataFrame:
    """The right row nearest to each left row."""
    w = Window.partitionBy(left_id).orderBy(F.abs(gap), tie)
    return pairs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def ladder(pairs: DataFrame, left_id: str, rank: Column, gap: Column, tie: str) -> DataFrame:
    """Of a left row's candidates, those of the best rank; rank 1 takes the nearest, others
    stand only if they are alone. Adds ``rank`` and ``candidates``."""
    w = Window.partitionBy(left_id)
    ranked = pairs.withColumn("rank", rank).withColumn("_best", F.min("rank").over(w)).filter(F.col("rank") == F.col("_best"))
    ranked = ranked.withColumn("candidates", F.count("*").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.abs(gap), tie)))
    return ranked.filter((F.col("_rn") == 1) & ((F.col("rank") == 1) | (F.col("candidates") == 1))).drop("_best", "_rn")


def unique_class(pairs: DataFrame, left_id: str, kind: str) -> DataFrame:
    """Left rows whose candidates are all of one kind, with the kind."""
    found = pairs.groupBy(left_id).agg(F.collect_set(kind).alias("_k")).filter(F.size("_k") == 1)
    return found.select(left_id, F.col("_k")[0].alias(kind))
