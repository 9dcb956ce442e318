"""Ladders that match a file's games with stored or reference games, rung by rung.

Each rung is a function of (unmatched incoming, stored) that gives pairs, for
``store.match_cascade``; none forms the product of two tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broadloom.operators.intervals import within

Rung = Callable[[DataFrame, DataFrame], DataFrame]


def by_key(incoming_key: str, stored_key: str, incoming_id: str, stored_id: str) -> Rung:
    """Equal keys: reference ids, links, or the id of a twin. Null and empty keys meet nothing."""
    def run(incoming: DataFrame, stored: DataFrame) -> DataFrame:
        a = incoming.filter(F.coalesce(F.col(incoming_key).cast("string"), F.lit("")) != "").select(incoming_id, F.col(incoming_key).alias("_k"))
        return a.join(stored.select(stored_id, F.col(stored_key).alias("_k")), "_k").select(incoming_id, stored_id)

    return run


def by_time(keys: list[str], at: str, stored_at: str, minutes: int, incoming_id: str, stored_id: str) -> Rung:
    """Equal names (or titles) within so many minutes."""
    def run(incoming: DataFrame, stored: DataFrame) -> DataFrame:
        b = stored.select(*keys, F.col(stored_at).alias("_stored_at"), stored_id)
        return within(incoming.select(*keys, at, incoming_id), b, keys, at, "_stored_at", -60 * minutes, 60 * minutes).select(incoming_id, stored_id)

    return run


def by_marks(at: str, stored_at: str, marks: str, stored_marks: str, incoming_id: str, stored_id: str, minutes: int = 30, least: int = 2) -> Rung:
    """Games whose channel marks meet within so many minutes: at least two common marks that
    are half of the file's, or all marks of the stored game. The largest overlap wins, then
    the smaller id. Games meet under each mark by an equi join; ``marks`` hold no repeats."""
    def run(incoming: DataFrame, stored: DataFrame) -> DataFrame:
        a = incoming.select(incoming_id, at, F.size(marks).alias("_n"), F.explode(marks).alias("_mark"))
        b = stored.select(stored_id, F.col(stored_at).alias("_stored_at"), F.size(stored_marks).alias("_m"), F.explode(stored_marks).alias("_mark"))
        met = within(a, b, ["_mark"], at, "_stored_at", -60 * minutes, 60 * minutes)
        common = met.groupBy(incoming_id, stored_id).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"), F.first("_m").alias("_m"))
        fit = common.filter(((F.col("_c") >= least) & (2 * F.col("_c") >= F.col("_n"))) | (F.col("_c") == F.col("_m")))
        return fit.groupBy(incoming_id).agg(F.min_by(stored_id, F.struct(-F.col("_c"), F.col(stored_id))).alias(stored_id))

    return run


def aligned(candidates: DataFrame, game: str, ref: str, rungs: list[tuple[str, Column]], order: list[Column]) -> DataFrame:
    """(game, ref, rung): each game's decision by the first rung that any of its candidates
    passes; within the rung the first by ``order``, and none ('disputed') if two candidates
    pass it that ``order`` cannot tell apart. Games without one: 'missed'."""
    number = F.lit(None).cast("int")
    for i, (_, test) in reversed(list(enumerate(rungs))):
        number = F.when(F.coalesce(test, F.lit(False)), F.lit(i)).otherwise(number)
    w = Window.partitionBy(game).orderBy("_rung", *order)
    ranked = candidates.withColumn("_rung", number).filter("_rung IS NOT NULL")
    ranked = ranked.withColumn("_rank", F.rank().over(w)).filter("_rank = 1")
    names = F.array(*(F.lit(n) for n, _ in rungs))
    best = ranked.groupBy(game).agg(F.countDistinct(ref).alias("_n"), F.min(ref).alias(ref), F.min("_rung").alias("_rung"))
    out = candidates.select(game).distinct().join(best, game, "left")
    rung = F.when(F.col("_n").isNull(), "missed").when(F.col("_n") > 1, "disputed").otherwise(F.get(names, F.col("_rung")))
    return out.select(game, F.when(F.col("_n") == 1, F.col(ref)).alias(ref), rung.alias("rung"))


def donor_rows(rows: DataFrame, game: str, value: str, votes: str, order: list[Column]) -> DataFrame:
    """Rows whose ``value`` is unknown take it from their game's donor: the row of the majority
    value that comes first. Games without a known value stay as they are."""
    known = rows.filter(F.col(value).isNotNull())
    n = known.groupBy(game, value).agg(F.sum(votes).alias("_n"))
    ranked = known.join(n, [game, value])
    w = Window.partitionBy(game).orderBy(F.desc("_n"), *order)
    donor = ranked.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(game, F.col(value).alias("_donor"))
    return rows.join(donor, game, "left").withColumn(value, F.coalesce(value, "_donor")).drop("_donor")


def covered_days(windows: DataFrame, key: str, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """(key, covered): do the windows of a key cover [low, high] without a hole?"""
    w = Window.partitionBy(key).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    rows = windows.withColumns({"_low": low, "_high": high}).filter((F.col(end) >= F.col("_low")) & (F.col(start) <= F.col("_high")))
    gaps = rows.withColumn("_reach", F.greatest(F.coalesce(F.max(end).over(w), F.col("_low")), F.col("_low")))
    judged = gaps.groupBy(key).agg(F.max((F.col(start) > F.col("_reach")).cast("int")).alias("_hole"), F.max(end).alias("_end"), F.first("_high").alias("_high"))
    out = windows.select(key).distinct().join(judged, key, "left")
    return out.select(key, F.coalesce((F.col("_hole") == 0) & (F.col("_end") >= F.col("_high")), F.lit(False)).alias("covered"))


def dictionary_faults(aliases: DataFrame, alias: str, lang: str, category: str, team: str) -> DataFrame:
    """(alias, lang, category, team, fault): exact copies beyond the last (null languages count
    as equal), and bare entries whose alias also stands with a category for that team."""
    key = [F.lower(alias), F.coalesce(lang, F.lit("")), F.coalesce(category, F.lit("")), F.col(team)]
    w = Window.partitionBy(*key)
    rows = aliases.withColumn("_n", F.row_number().over(w.orderBy(F.desc("id"))))
    marked = Window.partitionBy(F.lower(alias), team)
    rows = rows.withColumn("_marked", F.max((F.coalesce(category, F.lit("")) != "").cast("int")).over(marked))
    fault = F.when(F.col("_n") > 1, "copy").when((F.coalesce(category, F.lit("")) == "") & (F.col("_marked") == 1), "bare")
    return rows.withColumn("fault", fault).filter("fault IS NOT NULL").select("id", alias, team, "fault")


def sport_by_rules(rules: list[tuple[int, Column]], unknown: int = 10) -> Column:
    """struct(sport, rule): the first rule that gives a sport, '-' and ``unknown`` if none."""
    known = [F.when(c.isNotNull(), F.struct(c.alias("sport"), F.lit(n).alias("rule"))) for n, c in rules]
    return F.coalesce(*known, F.struct(F.lit("-").alias("sport"), F.lit(unknown).alias("rule")))
